import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import ordering as O
from strandline.operators import skew


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # a third of all rows share one value
    return [
        (i, i % 2, 5.0 if i % 3 == 0 else round(rng.random() * 10, 1), rng.randrange(1, 9) / 2) for i in range(300)
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, g int, v double, w double").cache()


@pytest.mark.parametrize("size", [7, 100_000])
def test_running_rows_equal_a_global_sort(df, rows, size):
    out = {r["id"]: r["cum_w"] for r in O.running_rows(df, ["g"], ["v"], "id", ["w"], rows=size).collect()}
    for g in (0, 1):
        total = 0.0
        for i, _, _, w in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            total += w
            assert out[i] == pytest.approx(total)


@pytest.mark.parametrize("size", [7, 100_000])
def test_running_totals(df, rows, size):
    counts = O.value_counts(df, ["g"], "v", "w")
    for r in O.running_totals(counts, ["g"], "v", ["n", "w"], rows=size).collect():
        mine = [x for x in rows if x[1] == r["g"] and x[2] <= r["v"]]
        assert r["cum_n"] == len(mine) and r["cum_w"] == pytest.approx(sum(x[3] for x in mine))


@pytest.mark.parametrize("case", ["plain", "poor sketch", "many groups"])
def test_brackets_give_the_exact_rank(spark, monkeypatch, case):
    """Ranks by sketch and bracket, with a sketch too poor to bracket them, and without one."""
    if case == "poor sketch":
        monkeypatch.setattr(O, "SKETCH_ACCURACY", 3)
    if case == "many groups":
        monkeypatch.setattr(O, "SKETCHED_GROUPS", 1)
    rng = np.random.default_rng(8)
    values = {0: rng.normal(size=20_000), 1: np.round(rng.exponential(size=7_000), 2), 2: np.array([3.5]), 3: np.full(900, -1.0)}
    flat = np.concatenate(list(values.values()))
    group = np.repeat(list(values), [len(v) for v in values.values()])
    df = spark.createDataFrame(list(zip(map(int, group), map(float, flat))), "g int, v double").repartition(16)
    ranks = {"first": lambda n: F.lit(1), "mid": lambda n: F.ceil(n * F.lit(0.37)), "last": lambda n: n, "beyond": lambda n: n + 1}
    got = {r["g"]: r for r in O.order_statistics(df, ["g"], "v", ranks, 500).collect()}
    for g, v in values.items():
        v, r = np.sort(v), got[g]
        assert (r["n"], r["first"], r["mid"], r["last"], r["beyond"]) == (len(v), v[0], v[math.ceil(len(v) * 0.37) - 1], v[-1], None)
    assert O.linear_quantile(df, [], "v", 0.613).first()["value"] == pytest.approx(np.quantile(flat, 0.613), abs=1e-12)


def test_only_the_bracket_is_counted(spark, monkeypatch):
    df = spark.range(50_000).select(F.xxhash64("id").alias("v"))
    written = {}
    real = O.materialise
    monkeypatch.setattr(O, "materialise", lambda d, label: written.setdefault(label, real(d, label)))
    value = O.order_statistic(df, [], "v", lambda n: F.floor(n * F.lit(0.8))).first()["value"]
    assert value == sorted(r["v"] for r in df.collect())[39_999]
    assert written["bracket"].count() < 50_000 * (2 * O.SKETCH_SLACK + 3) / O.SKETCH_CUTS


@pytest.mark.parametrize("size", [7, 100_000])
def test_quantiles(df, rows, size):
    for g in (0, 1):
        v = np.array([r[2] for r in rows if r[1] == g])
        w = np.array([r[3] for r in rows if r[1] == g])
        pick = lambda d: {r["g"]: r["value"] for r in d.collect()}[g]
        assert pick(O.linear_quantile(df, ["g"], "v", 0.37, rows=size)) == pytest.approx(np.quantile(v, 0.37))
        assert pick(O.upper_quantile(df, ["g"], "v", 0.8, rows=size)) == np.quantile(v, 0.8, method="higher")
        order = np.argsort(v, kind="mergesort")
        step = v[order][np.searchsorted(np.cumsum(w[order]), 0.9 * w.sum())]
        assert pick(O.weighted_step_quantile(df, ["g"], "v", "w", 0.9, rows=size)) == step
        c = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
        want = np.interp([0.0, 0.1, 0.5, 1.0], c, v[order])
        got = {r["g"]: r["values"] for r in O.midpoint_quantiles(df, ["g"], "v", "w", "id", [0.0, 0.1, 0.5, 1.0], rows=size).collect()}[g]
        assert got == pytest.approx(list(want))


def test_weighted_step_quantile_literals(spark):
    heavy = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (10.0, 8.0)], "v double, w double")
    assert O.weighted_step_quantile(heavy, [], "v", "w", 0.5).first()["value"] == 10.0
    invalid = spark.createDataFrame([(1.0, 1.0), (float("nan"), 10.0), (3.0, 0.0)], "v double, w double")
    assert O.weighted_step_quantile(invalid, [], "v", "w", 0.9).first()["value"] == 1.0


@pytest.mark.parametrize("seed,share", [(1, 0.05), (2, 0.33), (3, 0.5), (4, 1.0)])
def test_capacity_is_exact_at_ties(spark, seed, share):
    rng = random.Random(seed)
    keys = rng.sample(range(1000), 53)
    rows = [(k, rng.choice([0.25, 0.25, 0.75]) if seed % 2 else 0.5) for k in keys]
    df = spark.createDataFrame(rows, "id long, p double")
    flagged, report = O.capacity_flags(df, "p", "id", share, rows=5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))[: math.ceil(share * len(rows))]
    assert {r["id"] for r in flagged.where("flagged").collect()} == {k for k, _ in order}
    cut = order[-1][1]
    assert report == {
        "capacity_rows": len(order), "boundary_score": cut, "boundary_ties": sum(p == cut for _, p in rows),
        "boundary_ties_taken": sum(p == cut for _, p in order),
    }


def test_capacity_needs_sound_scores_and_keys(spark):
    good = [(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, p double")
    for bad in (None, float("nan"), float("inf"), float("-inf")):
        with pytest.raises(ValueError, match="finite"):
            O.capacity_flags(frame([*good, (5, bad)]), "p", "id", 0.5)
    with pytest.raises(ValueError, match="repeat"):
        O.capacity_flags(frame([*good, (2, 0.5)]), "p", "id", 0.4)
    with pytest.raises(ValueError, match="repeat"):
        O.capacity_flags(frame([*good, (None, 0.5)]), "p", "id", 0.4)


def test_capacity_on_mixed_scores(df, rows):
    flagged, _ = O.capacity_flags(df, "v", "id", 0.2, rows=11)
    want = {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[: math.ceil(0.2 * len(rows))]}
    assert {r["id"] for r in flagged.where("flagged").collect()} == want


def test_dense_index_follows_cell_then_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 9), ("b", 1), ("c", 0)], "c string, v int")
    out = {(r["c"], r["v"]): r["index"] for r in O.dense_index(df, [], ["c"], ["v"]).collect()}
    assert out == {("a", 9): 0, ("b", 1): 1, ("b", 2): 2, ("c", 0): 3}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(0 if i % 3 == 0 else i % 7, i) for i in range(200)], "k int, x int")
    right = spark.createDataFrame([(k, j) for k in range(5) for j in range(2)], "k int, y int")
    got = skew.spread_join(left, right, ["k"], how, rows=20)
    plain = left.join(right, ["k"], how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_lookup_join_beyond_the_bound(spark):
    left = spark.createDataFrame([(i % 7, i) for i in range(50)], "k int, x int")
    right = spark.createDataFrame([(k, k * 2) for k in range(5)], "k int, y int")
    small = skew.lookup_join(left, right, ["k"], "left", rows=100)
    large = skew.lookup_join(left, right, ["k"], "left", rows=2)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_running_rows_without_groups(df, rows):
    out = {r["id"]: r["cum_w"] for r in O.running_rows(df, [], ["v"], "id", ["w"], rows=7).collect()}
    total = 0.0
    for i, _, _, w in sorted(rows, key=lambda r: (r[2], r[0])):
        total += w
        assert out[i] == pytest.approx(total)
    assert len(out) == len(rows)


@pytest.mark.parametrize("size", [1, 3, 200_000])
def test_any_type_orders_rows_alike_at_every_size(spark, size):
    rng = random.Random(47)
    infinite = float("inf")
    rows = [(i % 2, rng.choice([-infinite, 0.5, 0.5, 2.0, infinite]), f"k{rng.randrange(10**6):06d}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "g int, v double, t string, i int")
    out = {r["i"]: r["cum_one"] for r in O.running_rows(df.withColumn("one", F.lit(1)), ["g"], ["v"], "t", ["one"], rows=size).collect()}
    for g in (0, 1):
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            assert out[r[3]] == place
    dates = df.withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    last = O.running_totals(dates, ["g"], "d", ["i"], rows=size).groupBy("g").agg(F.max("cum_i").alias("s")).collect()
    assert {r["g"]: r["s"] for r in last} == {g: sum(r[3] for r in rows if r[0] == g) for g in (0, 1)}
    with pytest.raises(Exception, match="must not be null"):
        O.running_rows(df.withColumn("t", F.lit(None).cast("string")), ["g"], ["v"], "t", ["i"], rows=size).collect()


def test_null_keys_stop_instead_of_losing_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 1, 3.0)], "id long, g int, v double")
    with pytest.raises(Exception, match="g must not be null"):
        O.linear_quantile(df, ["g"], "v", 0.5).collect()
    with pytest.raises(Exception, match="g must not be null"):
        O.order_number(df, ["g"], ["v"], "id").collect()
