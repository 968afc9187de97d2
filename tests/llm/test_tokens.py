import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import tokens as K
from strandline.session import scratch_path

pytestmark = pytest.mark.skipif(not os.path.isdir(K.TOKENIZER_DIR), reason="no tokenizer files")
SCHEMA = "op string, seq int, doc_id long, tokenizer_version string, source string, lang string, n_tokens long"


def ledger(spark):
    return K.TokenLedger(spark, scratch_path(spark, "test-ledger"))


def changes(spark, *rows):
    return spark.createDataFrame([(op, seq, doc, "v1", src, "en", n) for op, seq, doc, src, n in rows], SCHEMA)


def totals(book):
    return {r.source: (r.n_docs, r.n_tokens) for r in book.totals().collect()}


def test_counts_are_those_of_the_tokenizer(spark):
    texts = ["", None, "Hello world", "naïve café — 東京 123's", "a" * 3000, "word " * 20_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    df = df.withColumn("n_tokens", F.lit(-1)).withColumn("tokenizer_version", F.lit("x"))
    got = {r.doc_id: (r.n_tokens, r.tokenizer_version) for r in K.counted(df).collect()}
    encode = K.encoding(K.TOKENIZER_DIR, K.VERSION).encode_ordinary
    assert got == {i: (len(encode(t)) if t else 0, K.VERSION) for i, t in enumerate(texts)}


def test_pattern_cuts_like_the_public_one():
    import public_tokenizers
    import tiktoken

    mine = K.encoding(K.TOKENIZER_DIR, K.VERSION)
    other = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine._mergeable_ranks, special_tokens={})
    for text in ("don't we'll  they've\n\n x's", "  a\t\tb 12,5 €", "'s 't 're", "É's"):
        assert mine.encode_ordinary(text) == other.encode_ordinary(text)


def test_signed_changes_keep_the_totals(spark):
    book = ledger(spark)
    assert book.commit("1", changes(spark, ("insert", 0, 1, "a", 10), ("insert", 0, 2, "a", 5), ("insert", 0, 3, "b", 7)))
    assert totals(book) == {"a": (2, 15), "b": (1, 7)}
    assert book.commit("2", changes(spark, ("delete", 0, 2, None, 0), ("revise", 0, 3, "c", 9), ("delete", 0, 99, None, 0)))
    assert totals(book) == {"a": (1, 10), "c": (1, 9)}
    assert book.commit("3", changes(spark, ("insert", 0, 2, "a", 6), ("revise", 0, 1, "a", 10), ("revise", 0, 50, "d", 1)))
    assert totals(book) == {"a": (2, 16), "c": (1, 9), "d": (1, 1)}


def test_a_batch_counts_once(spark):
    book = ledger(spark)
    batch = changes(spark, ("insert", 0, 1, "a", 10))
    assert book.commit("1", batch) and not book.commit("1", batch)
    assert totals(book) == {"a": (1, 10)} and book.batches() == ["1"]


def test_rows_without_a_marker_are_not_read(spark):
    book = ledger(spark)
    book.commit("1", changes(spark, ("insert", 0, 1, "a", 10)))
    lost = changes(spark, ("insert", 0, 2, "a", 99)).select(*K.STATE, F.lit(1).alias("sign")).withColumn("bucket", book.bucket())
    lost.write.partitionBy("bucket").parquet(f"{book.root}/signed/2")
    K.added_up(lost, F.col("sign"), F.col("n_tokens")).write.parquet(f"{book.root}/rollups/2")
    assert totals(book) == {"a": (1, 10)}
    book.commit("2", changes(spark, ("insert", 0, 2, "a", 3)))
    assert totals(book) == {"a": (2, 13)}


def test_defined_cases(spark):
    book = ledger(spark)
    book.commit("0", changes(spark))
    book.commit(
        "1",
        changes(
            spark, ("insert", 0, 1, None, 4), ("insert", 1, 1, None, 6), ("insert", 1, 1, None, 6), ("insert", 0, None, "a", 2), ("insert", 0, None, "a", 2),
            ("delete", 0, None, "a", 2), ("insert", 0, 5, "a", 1), ("delete", 1, 5, None, 0),
        ),
    )
    assert totals(book) == {None: (1, 6), "a": (2, 4)}
    book.commit("2", changes(spark, ("revise", 0, 1, None, 1)))
    assert totals(book)[None] == (1, 1)


def test_a_small_batch_reads_its_buckets_only(spark):
    book = ledger(spark)
    book.commit("1", changes(spark, *[("insert", 0, i, "a", 1) for i in range(500)]))
    batch = changes(spark, ("revise", 0, 7, "b", 5))
    mine = batch.select(book.bucket().alias("b")).first()["b"]
    whole, part = book.signed(), book.signed([mine])
    held = whole.where(F.col("bucket") == mine).count()
    assert whole.count() == 500 and part.count() == held < 500 / 8
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert book.commit("2", batch) and totals(book) == {"a": (499, 499), "b": (1, 5)}


@pytest.mark.parametrize("every", [2, 100])
def test_totals_equal_a_recount_after_random_batches(spark, every):
    rng = random.Random(every)
    book = K.TokenLedger(spark, scratch_path(spark, "test-ledger"), buckets=4, compact_every=every)
    live = {}
    for name in range(7):
        rows = []
        for doc in rng.sample(range(20), rng.randrange(0, 9)):
            op, src, n = rng.choice(["insert", "revise", "delete"]), rng.choice("ab"), rng.randrange(1, 50)
            rows.append((op, 0, doc, src, n))
            live.pop(doc, None) if op == "delete" else live.update({doc: (src, n)})
        batch = changes(spark, *rows)
        if name == 3:  # an attempt that lost its marker wrote other rows
            lost = changes(spark, ("insert", 0, 1, "z", 99)).select(*K.STATE, F.lit(1).alias("sign")).withColumn("bucket", book.bucket())
            lost.write.partitionBy("bucket").parquet(f"{book.root}/signed/{name}")
        assert book.commit(str(name), batch)
        assert not book.commit(str(name), batch)
        want = {}
        for src, n in live.values():
            docs, tokens = want.get(src, (0, 0))
            want[src] = docs + 1, tokens + n
        assert totals(book) == want
    assert bool(book._compacted()[1]) == (every == 2)
