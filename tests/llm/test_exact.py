import random
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import exact as X

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """Sorted (doc_id, keep_id, group_size, kept) of rows (doc_id, text)."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for docs in groups.values():
        keep = max((d for d in docs if d is not None), default=None)
        kept = False
        for doc in docs:
            mine = doc == keep and not kept
            kept = kept or mine
            out.append((doc, keep, len(docs), mine))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = X.copies(df, **options).collect()
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str)


def test_against_plain_groups(spark):
    rng = random.Random(3)
    stems = ["", None, "Straße", "STRASSE", "straße", "x" * 80 + "a", "x" * 80 + "b", "É", "é", "word " * 40, "WORD " * 40, "\x00\n"]
    rows = [(i, rng.choice(stems)) for i in range(300)] + [(7, "Straße"), (7, "straße"), (None, "É"), (None, "only here"), (None, None)]
    rng.shuffle(rows)
    assert found(spark, rows) == plain(rows) == found(spark, rows, digests=True)


def test_only_survivors_are_hashed(spark):
    rows = [(1, "alone by length"), (2, "a" * 70 + "1"), (3, "a" * 70 + "2"), (4, "b" * 71), (5, "Same"), (6, "same")]
    got = {r.doc_id: r for r in X.copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    # two rows share length and prefix but not the text; two others are copies
    assert [d for d in sorted(got) if got[d].digest is not None] == [2, 3, 5, 6]
    assert [got[d].keep_id for d in (2, 3, 5, 6)] == [2, 3, 6, 6]


def test_a_full_bit_map_changes_nothing(spark, monkeypatch):
    rows = [(i, f"text {i % 40_000}") for i in range(45_000)]
    monkeypatch.setattr(X, "MAX_PAGES", 1)
    monkeypatch.setattr(X, "PREFIX_CHARS", 8)
    assert found(spark, rows) == plain(rows)


def test_group_of_copies_over_long_texts(spark):
    long = "Long text. " * 400_000
    rows = [(1, long), (2, long.lower()), (3, long + "x"), *[(i, "hot") for i in range(10, 2_000)]]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
    assert X.drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_keeps_one_row_of_each_class_and_all_columns(spark):
    rows = [(1, "A"), (2, "a"), (2, "a"), (2, "b"), (None, "B"), (None, "n"), (None, "N"), (3, None), (4, "")]
    names = ["row_key", "_row_key", "digest", "keep_id", "n_bytes", "prefix", "bits", "page", "found", "body"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(n) for n in names})
    got = X.drop_copies(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=str)
    assert kept == sorted([(2, "a"), (2, "b"), (None, "n"), (4, "")], key=str)


@pytest.mark.parametrize("python", ["ArrowEvalPython", "MapInArrow", "BatchEvalPython"])
def test_plan_is_native(spark, python):
    df = spark.createDataFrame([(1, "a"), (2, "A")], SCHEMA)
    assert python not in X.copies(df)._jdf.queryExecution().executedPlan().toString()
