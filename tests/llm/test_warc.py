import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import warc as W

PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>same</p>"),
    (3, "http://a/\r\nX: y", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n"),
    (4, None, ""),
    (5, "u", None),
    (6, "u", "x" * 100_000),
    (6, "u", "x" * 100_000),
    (7, "u", "<p>same</p>"),
    (None, "u", "<p>same</p>"),
    (None, "u", "alone"),
]


def expected(pages):
    out = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "") == (html or "") and p is not None]
        first = min(ids) if ids else None
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def frame(spark):
    return spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, record string")


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_records_come_back(spark, chunk):
    got = W.read_records(W.write_chunks(frame(spark), chunk=chunk)).collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)


def test_small_payloads_are_responses(spark):
    got = {r.page_id: r.record_type for r in W.read_records(W.write_chunks(frame(spark), min_bytes=50)).collect()}
    assert got[2] == got[5] == got[7] == "response"


def test_chunks_of_an_archive_are_a_warc_file(spark):
    table = W.write_chunks(frame(spark).coalesce(1), chunk=1000)
    assert table.agg(F.max(F.length("body"))).first()[0] < 2000
    data = b"".join(bytes(r.body) for r in table.orderBy("archive", "record", "chunk_no").collect())
    at, seen = 0, 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        at += len(head) + 4 + int(fields[b"Content-Length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at, seen = at + 4, seen + 1
    assert seen == len(PAGES)


def test_damage_is_noticed(spark):
    table = W.write_chunks(frame(spark), chunk=1000)
    bad = table.withColumn("body", F.when(F.col("chunk_no") == 3, F.lit(b"y" * 1000)).otherwise(F.col("body")))
    with pytest.raises(Exception, match="damaged record"):
        W.read_records(bad).collect()
    with pytest.raises(Exception, match="a chunk is missing"):
        W.read_records(table.where("chunk_no <> 3")).collect()


def test_twin_and_empty(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p for p in PAGES if p[0] is not None])
    assert sorted(con.execute(W.pages_sql()).fetchall(), key=str) == expected([p for p in PAGES if p[0] is not None])
    assert W.read_records(W.write_chunks(frame(spark).limit(0))).count() == 0
