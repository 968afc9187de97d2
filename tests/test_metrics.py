import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import draws as G
from strandline.operators import metrics as M
from strandline.operators import resample as S


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    rows = []
    for i in range(240):
        p = 0.3 if i % 3 == 0 else round(rng.random() * 0.8 + 0.1, 2)
        rows.append((i, i % 2, p, int(rng.random() < p), rng.randrange(1, 7) / 2, i % 5, i % 20))
    return rows


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id long, g int, p double, y int, w double, stratum int, cluster int").cache()


def auroc(y, p, w):
    pairs = [(wi * wj, (pi > pj) + 0.5 * (pi == pj)) for yi, pi, wi in zip(y, p, w) if yi for yj, pj, wj in zip(y, p, w) if not yj]
    return sum(a * b for a, b in pairs) / sum(a for a, _ in pairs)


def average_precision(y, p, w):
    total = 0.0
    for t in sorted(set(p)):
        flagged = p >= t
        total += w[(p == t) & (y == 1)].sum() * w[flagged & (y == 1)].sum() / w[flagged].sum()
    return total / w[y == 1].sum()


@pytest.mark.parametrize("rows", [9, 100_000])
def test_metrics_match_definitions(df, data, rows):
    out = {r["g"]: r for r in M.binary_metrics(df, ["g"], "p", "y", "w", rows=rows).collect()}
    for g in (0, 1):
        y, p, w = (np.array([r[k] for r in data if r[1] == g], dtype=float) for k in (3, 2, 4))
        r = out[g]
        assert r["auroc"] == pytest.approx(auroc(y, p, w))
        assert r["auprc"] == pytest.approx(average_precision(y, p, w))
        assert r["brier"] == pytest.approx(np.average((p - y) ** 2, weights=w))
        assert r["log_loss"] == pytest.approx(np.average(-(y * np.log(p) + (1 - y) * np.log(1 - p)), weights=w))
        assert r["observed_expected"] == pytest.approx((w * y).sum() / (w * p).sum())
        assert r["n_rows"] == len(y) and r["event_count"] == int(y.sum())


def test_one_class_is_undefined(df):
    r = M.binary_metrics(df.where("y = 1"), [], "p", "y", "w").first()
    assert r["auroc"] is None and r["status"] == "UNDEFINED_SINGLE_OUTCOME_CLASS"


def test_average_precision_tie_rules_differ(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (2, 0.5, 1), (3, 0.2, 1)], "id long, p double, y int").withColumn("g", F.lit(0))
    value = lambda d: d.first()["average_precision"]
    assert value(M.average_precision_rows(df, ["g"], "p", "y", "id")) == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert value(M.average_precision_rows(df, ["g"], "p", "y", "id", positives_first=True)) == pytest.approx((1 + 2 / 3) / 2)
    grouped = M.binary_metrics(df, ["g"], "p", "y").first()["auprc"]
    assert grouped == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_fit_logit_recovers_and_reports_unidentified(spark):
    rows = []
    for x in np.linspace(-2, 2, 41):
        p = 1 / (1 + math.exp(-x))
        rate = 1 / (1 + math.exp(-(0.3 + 0.7 * x)))
        rows.append(("ok", p, 100.0 * rate, 100.0 * (1 - rate)))
    rows += [("flat", 0.4, 3.0, 4.0)]
    table = spark.createDataFrame(rows, "g string, p double, pos double, neg double")
    out = {r["g"]: r for r in M.fit_logit(table, ["g"]).collect()}
    assert out["ok"]["calibration_intercept"] == pytest.approx(0.3, abs=1e-6)
    assert out["ok"]["calibration_slope"] == pytest.approx(0.7, abs=1e-6)
    assert out["flat"]["calibration_slope"] is None and out["flat"]["calibration_status"] == "UNIDENTIFIED"


def test_decision_curve_matches_threshold_report(df):
    at = 0.3
    curve = M.decision_curve(df, ["g"], "p", "y", "w", [0.1, at, 0.5]).where(F.col("threshold") == at)
    report = M.threshold_report(df.withColumn("t", F.lit(at)), ["g"], "p", "y", "w", "t")
    left = {r["g"]: r["net_benefit"] for r in curve.collect()}
    right = {r["g"]: r["net_benefit"] for r in report.collect()}
    assert left == pytest.approx(right)


def test_equal_count_bins_follow_the_position_rule(df, data):
    out = {r["id"]: r["bin"] for r in M.with_equal_count_bin(df, [], "p", "id").collect()}
    n = len(data)
    edges = np.quantile(np.arange(n), np.linspace(0, 1, 11))
    for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[0]))):
        want = max(1, int(np.searchsorted(edges, i, side="left")))
        assert out[r[0]] == want


# resampling -----------------------------------------------------------------------

def test_draws_fill_every_stratum(spark, df):
    draws = G.draw_table(G.plan_draws(df, ["stratum"], "cluster", 12, seed=3))
    sizes = df.select("stratum", "cluster").distinct().groupBy("stratum").count()
    totals = draws.groupBy("stratum", "replicate").agg(F.sum("mult").alias("m")).join(sizes, "stratum")
    assert totals.count() == 12 * 5 and totals.where("m <> count").isEmpty()
    again = G.draw_table(G.plan_draws(df.repartition(3), ["stratum"], "cluster", 12, seed=3))
    assert sorted(map(tuple, draws.collect())) == sorted(map(tuple, again.collect()))


def test_single_cluster_stratum_is_kept_once(spark):
    clusters = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "s string, c int")
    draws = G.draw_table(G.plan_draws(clusters, ["s"], "c", 20, seed=1)).where("s = 'a'").collect()
    assert len(draws) == 20 and {r["mult"] for r in draws} == {1}


def test_sums_without_groups(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "c int, v double")
    plan = G.plan_draws(df, [], "c", 9, 2, 16)
    got = {r.replicate: r.v for r in S.replicate_sums(df, plan, [], {"v": F.sum("v")}).collect()}
    met = df.join(G.draw_table(plan), "c").groupBy("replicate").agg(F.sum(F.col("v") * F.col("mult")).alias("v"))
    assert got == {r.replicate: r.v for r in met.collect()}


@pytest.mark.parametrize("block", [4096, 2])
def test_replicate_metrics_equal_repeated_rows(df, block):
    plan = G.plan_draws(df, [], "cluster", 4, 9, block)
    got = {r["replicate"]: r for r in S.replicate_metrics(df, plan, [], "p", "y", "w").collect()}
    repeated = df.join(G.draw_table(plan), "cluster").select("replicate", "p", "y", F.explode(F.array_repeat("w", F.col("mult"))).alias("w"))
    want = {r["replicate"]: r for r in M.binary_metrics(repeated, ["replicate"], "p", "y", "w").collect()}
    assert want and set(got) == set(want)
    for k in want:
        for metric in ("auroc", "auprc", "brier", "log_loss", "n_rows"):
            assert got[k][metric] == pytest.approx(want[k][metric])


@pytest.mark.parametrize("block,fan", [(4096, 1024), (16, 1024), (16, 2), (3, 5)])
def test_draws_are_those_of_the_rule_in_sql(spark, monkeypatch, block, fan):
    monkeypatch.setattr(G, "FAN", fan)
    monkeypatch.setattr(G, "LEVELS", 8)
    rows = [(s, i) for s, n in (("a", 150), ("b", 1), ("c", 16), ("d", 35)) for i in range(n)]
    plan = G.plan_draws(spark.createDataFrame(rows, "s string, c int"), ["s"], "c", 25, 5, block)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT unnest($1) AS s, unnest($2) AS c", [[r[0] for r in rows], [r[1] for r in rows]])
    want = con.execute(G.draws_sql("t", "s", "c", 25, 5, block)).fetchall()
    assert sorted(map(tuple, G.draw_table(plan).collect())) == sorted(want)


def test_block_counts_are_binomial():
    u = (np.arange(20_000) + 0.5) / 20_000
    for n, p in ((1, 0.5), (12, 0.3), (4_000, 0.71), (3, 1.0), (5, 0.0), (100_000_000, 0.5)):
        k = G.binomial(u, np.full(len(u), n), p)
        sd = math.sqrt(n * p * (1 - p))
        assert abs(k.mean() - n * p) <= 1e-3 * sd + 1e-9 and abs(k.std() - sd) <= 0.01 * sd + 1e-2 * (n < 20)
        assert (np.diff(k) >= 0).all() and 0 <= k.min() and k.max() <= n
    sums = np.array([math.comb(12, j) * 0.3**j * 0.7 ** (12 - j) for j in range(13)]).cumsum()
    assert (G.binomial(u, np.full(len(u), 12), 0.3) == np.searchsorted(sums, u)).all()


def test_multiplicities_are_uniform():
    times = G.multiplicities("seed", 3, 50, np.full(4_000, 50))
    assert (times.sum(axis=0) == 50).all()
    assert abs(times.mean(axis=1) - 1).max() < 0.08 and times.var() == pytest.approx(0.98, abs=0.02)


def test_sums_of_many_packs_equal_the_joined_table(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 3)
    rows = [(i % 3 if i < 120 else 7, i, i % 5 % 2, f"g{i % 4}") for i in range(121)] + [(0, 0, 1, "g9")]
    df = spark.createDataFrame(rows, "bin int, id long, y int, g string")
    plan = G.plan_draws(df, ["bin"], "id", 30, 5, 8)
    got = S.replicate_sums(df, plan, ["g"], {"n": F.count(F.lit(1)), "k": F.sum(F.col("y") * 0.5)})
    met = df.join(G.draw_table(plan), ["bin", "id"]).groupBy("replicate", "g")
    want = met.agg(F.sum("mult").alias("n"), F.sum(F.col("mult") * F.col("y") * 0.5).alias("k"))
    flat = lambda t: sorted((r.replicate, r.g, r.n, r.k) for r in t.where("n > 0").collect())
    assert plan.packs > 5 and flat(got) == flat(want) and got.schema["n"].dataType.typeName() == "long"


def test_event_counts_follow_the_rows_drawn(spark):
    bins = spark.createDataFrame([("a", 40, 10), ("b", 7, 0), ("c", 7, 7)], "bin string, n long, events long")
    got = G.event_counts(bins, ["bin"], "n", "events", 2_000, 3)
    by = {r.bin: r for r in got.groupBy("bin").agg(F.avg("events").alias("m"), F.stddev_pop("events").alias("s"), F.count("*").alias("n")).collect()}
    assert by["a"].m == pytest.approx(10, abs=0.2) and by["a"].s == pytest.approx(math.sqrt(7.5), abs=0.15)
    assert (by["b"].m, by["c"].m, by["c"].n) == (0, 7, 2_000)


def test_holm_steps_down(spark):
    tests = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    out = {r["name"]: r["adjusted_p"] for r in S.holm(tests, ["family"], "p", "name").collect()}
    assert out == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_bins_are_resampled_a_thousand_times():
    from strandline.plans import evaluation

    assert evaluation.BIN_REPS >= 1000


def test_entities_are_resampled_a_thousand_times_for_bounds():
    from strandline.plans import evaluation

    assert evaluation.ENTITY_REPS >= 1000
