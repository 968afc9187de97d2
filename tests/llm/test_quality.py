import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality as Q

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_linear_time_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = Q.Machine(rng.normal(size=Q.SIZE).astype(np.float32), rng.normal(size=(Q.SIZE, Q.RANK)).astype(np.float32))
    for text in ("", "one", "a b c a b", "Ä ö\n!! ## x x x"):
        index, value = Q.features(text, 3)
        plain = sum(model.linear[i] * v for i, v in zip(index, value))
        for a in range(len(index)):
            for b in range(a):
                plain += float(model.factors[index[a]] @ model.factors[index[b]]) * value[a] * value[b]
        margin, _ = model.margins(index, value, np.array([0]))
        assert margin[0] == pytest.approx(plain, rel=1e-4, abs=1e-4)


def test_slopes_are_those_of_the_loss():
    rows = [(i % 2, *Q.features(t, None)) for i, t in enumerate(["good words here", "bad !! !! !!"] * 40)]
    model = Q.fit(rows)
    wrong = sum((model.margins(i, v, np.array([0]))[0][0] > 0) != y for y, i, v in rows)
    assert wrong == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")
def test_held_out_labels_are_met(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = Q.train(docs, labels)
    rows = Q.score(docs, model, ("doc_id",)).join(labels, "doc_id").where(Q.held_out("doc_id")).collect()
    assert len(rows) > 50
    assert np.mean([(r.score >= Q.THRESHOLD) == (r.quality == 1) for r in rows]) >= 0.95
    good = [r for r in rows if r.quality == 1]
    assert sum(r.score < Q.THRESHOLD for r in good) <= 0.02 * len(good)


def test_held_out_rule(spark):
    rows = spark.range(50).select("id", Q.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7 + 1)) for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels, length_col=None), Q.train(docs, turned, length_col=None)
    assert np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


def test_defined_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, 3), (2, "", 0), (3, "a b", None), (3, "a b", None), (None, "a b", 3), (4, "word " * 60_000, 1)], "doc_id long, text string, n_chars long"
    ).withColumns({"score": F.lit("old"), "quality": F.lit(9)})
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1)], "doc_id long, quality int")
    model = Q.train(docs.drop("quality"), labels)
    rows = Q.score(docs, model, ("doc_id", "score")).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    blank = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, blank, ("doc_id",)).collect()} == {0.5}
    kept = Q.keep_good(docs, blank, threshold=0.5)
    assert kept.count() == 6 and kept.columns == docs.columns
    assert Q.keep_good(docs.limit(0), blank).count() == 0


@pytest.mark.parametrize("n", [49, 60, 72, 73, 96, 110, 120])
def test_stretches_reach_the_last_word(n):
    clean = [f"word{i}" for i in range(n)]
    junk = [*clean[:-1], "#" * 400]
    signs = lambda words: Q.statistics(" ".join(words), words, None)[12]  # the worst stretch's share of signs
    assert signs(clean) == 0 and signs(junk) > 0
