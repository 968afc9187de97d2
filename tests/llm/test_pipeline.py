import os
import random

import corpus_pipeline as pipeline
import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Own tables with planted cases: copies, a near copy, a benchmark passage, junk, personal data, nulls."""
    rng = random.Random(12)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("sen", "dor", "vil", "pan", "mok", "gir", "lus")]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item = prose(40)
    docs, labels = [], []
    for i in range(240):
        bad = i % 4 == 3
        docs.append((i, " ".join(w.upper() + "!!" for w in prose(60).split()) if bad else prose(80), "en", "s0" if i % 10 < 8 else "s1"))
        labels.append((i, 0 if bad else 1))
    docs += [(1000, docs[0][1], "en", "s1"), (1001, docs[1][1].replace(docs[1][1].split()[40], "changed", 1), "en", "s1")]
    docs += [(1002, f"{prose(30)} {item} {prose(30)}", "en", "s2"), (1003, f"{prose(70)} write to me@home.example.org now", "en", "s2")]
    docs += [(1004, None, None, None), (1005, "", "en", None), (None, prose(60), "en", "s0")]
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, l, s, None if t is None else len(t)) for d, t, l, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        assert docs.columns[: len(columns)] == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    good = seen["quality classifier"]
    assert sum(i in good for i in range(240) if i % 4 == 3) <= 1 and sum(i in good for i in range(240) if i % 4 != 3) >= 178
    single = seen["SimHash near-dedup"]
    assert {0, 1} <= set(single) and not {1000, 1001} & set(single) and len(good) - len(single) == len({1000, 1001} & set(good))
    assert set(single) - set(seen["benchmark decontamination"]) == {1002}
    assert "me@home" not in seen["PII"][1003] and "<EMAIL>" in seen["PII"][1003]
    assert set(seen["PII"]) == set(seen["benchmark decontamination"])
    assert set(seen["mixing to target weights"]) < set(seen["PII"])


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
def test_run_is_the_stages_one_after_the_other(spark):
    out = pipeline.run(spark, SF_DIR)
    rows = out.collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)
    assert [n for n, _ in pipeline.STAGES][1] == "SimHash near-dedup" and pipeline.ORACLE_SQL is None
