import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import hashtree as H
from strandline.session import scratch_path

SCHEMA = "k long, a string, b double"


def published(spark, rows, ranged=None, parts=3, **options):
    path = scratch_path(spark, "tree-test")
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    H.publish(df, path, "k", H.hashed_range(F.col("k"), options.get("bits", H.RANGE_BITS)) if ranged is None else ranged, **options)
    return path


def found(spark, old, new, **options):
    return {(r.k, r.status) for r in H.differences(spark, old, new, "k", **options).collect()}


@pytest.mark.parametrize("bits", [12, 10, 4])
def test_differences_are_those_of_a_full_comparison(spark, bits):
    rng = random.Random(bits)
    old = {k: (rng.choice(["x", "", None]), rng.choice([1.0, None])) for k in rng.sample(range(5_000), 400)}
    new = dict(old)
    for k in rng.sample(sorted(old), 25):
        del new[k]
    for k in rng.sample(sorted(new), 25):
        new[k] = (("", None) if new[k][0] != "" else (None, 1.0))
    new |= {9_000 + i: ("x", 1.0) for i in range(5)}
    want = {(k, "REMOVED") for k in old.keys() - new.keys()} | {(k, "ADDED") for k in new.keys() - old.keys()}
    want |= {(k, "CHANGED") for k in old.keys() & new.keys() if old[k] != new[k]}
    flat = lambda t: [(k, *v) for k, v in t.items()]
    a, b = published(spark, flat(old), bits=bits), published(spark, flat(new), parts=5, bits=bits)
    assert found(spark, a, b, bits=bits) == want


def test_equal_tables_have_no_differing_range(spark):
    rows = [(i % 40, str(i), None) for i in range(100)]
    a, b = published(spark, rows), published(spark, rows[::-1], parts=7)
    assert H.differing_ranges(spark, a, b) == [] and found(spark, a, b) == set()
    empty = published(spark, [])
    assert found(spark, empty, empty) == set()
    assert found(spark, empty, a) == {(k, "ADDED") for k in range(40)}


def test_only_ranges_that_differ_are_read(spark):
    ranged = H.even_range(F.col("k"), 0, 9_999)
    old = [(i, "same", 1.0) for i in range(10_000)]
    new = [(i, "new" if 4_000 <= i < 4_010 else "same", 1.0) for i in range(10_000)]
    a, b = published(spark, old, ranged), published(spark, new, ranged)
    ranges = H.differing_ranges(spark, a, b)
    assert 0 < len(ranges) <= 6
    rows = H.rows_of(spark, a, ranges)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() < 30 and "PartitionFilters: [" in plan and "In(_range" in plan
    assert found(spark, a, b) == {(i, "CHANGED") for i in range(4_000, 4_010)}


def test_values_do_not_run_into_each_other(spark):
    a = published(spark, [(1, "1|v", None), (2, "n", None)])
    b = published(spark, [(1, "1|v", None), (2, None, None)])
    assert found(spark, a, b) == {(2, "CHANGED")}


def test_null_keys_stop_the_write(spark):
    with pytest.raises(Exception, match="null"):
        published(spark, [(None, "a", 1.0)])
