"""The results that the queries are bound to, against plain Python on the smallest tables."""

import base64
import hashlib
import os
import re
import zlib

import pytest

from strandline.llm import queries as Q

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_personal_data(spark, texts):
    from test_pii import plain_spans

    order = ("email", "ip", "card", "phone", "secret")
    rows = Q.op3_personal_data(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)
    for r in rows:
        spans = sorted(plain_spans(texts[r.doc_id]), key=lambda s: (s[1], order.index(s[0])))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in order[:4]]
        written = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        found = r.spans.split(",") if r.spans else []
        assert set(written) <= set(found)
        places = [(int(f.split(":")[1]), order.index(f.split(":")[0])) for f in found]
        assert places == sorted(places)


def test_audio(spark, texts):
    for r in Q.op4_telephony_audio(spark, SF_DIR).collect():
        body = texts[r.doc_id].encode()
        payload = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r.n_bytes, r.payload_bytes) == (len(body), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])


def test_fingerprints(spark, texts):
    from test_simhash import plain_print

    rows = Q.op2_simhash_classes(spark, SF_DIR).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{plain_print(t):016x}" for d, t in texts.items()}
    assert all(r.component_id <= r.doc_id for r in rows)


def test_warc(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in Q.op7_warc_chunks(spark, SF_DIR).collect():
        body = pages[r.page_id]
        first = min(p for p, b in pages.items() if b == body)
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))


def test_scores(spark, texts):
    rows = Q.op8_quality_machine(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))
