"""Steps behind intervals from replicates: what is dealt, and how often work is repeated."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import draws as G
from strandline.operators import resample as S


def test_few_keys_make_few_matrices():
    # 5.7 million sums of 6,000 clusters: 174 parts of each pack before
    assert G.key_parts(5_700_000, 8_000, 2) == 16
    assert G.key_parts(400_000_000, 8_000, 88) == 9
    # a part holds no more keys than before, however many there are
    assert G.key_parts(5_700_000, 5_700_000, 2) == 174
    assert G.key_parts(10, 10, 1) == 1 and G.key_parts(0, 0, 1) == 1


@pytest.mark.parametrize("few,step", [(16_384, 512), (7, 3)])
def test_products_equal_drawn_rows(spark, monkeypatch, few, step):
    monkeypatch.setattr(G, "FEW_ROWS", few)
    monkeypatch.setattr(G, "STEP", step)
    rows = [(i % 5, i % 37, i % 11, i) for i in range(400)] + [(None, 3, 2, 9)]
    sums = spark.createDataFrame(rows, "k int, c int, j int, v long").groupBy("k", "j", "c").agg(F.sum("v").alias("v"), F.avg("v").alias("a"))
    plan = G.plan_draws(sums, [], "c", 6, 4, 8)
    got = {(r.replicate, r.k, r.j): (r.v, r.a) for r in G.added_up(sums, plan, ["k", "j"], ["v", "a"]).where("v <> 0").collect()}
    met = sums.join(G.draw_table(plan), "c").groupBy("replicate", "k", "j")
    want = met.agg(F.sum(F.col("v") * F.col("mult")).alias("v"), F.sum(F.col("a") * F.col("mult")).alias("a")).where("v <> 0").collect()
    assert want and set(got) == {(r.replicate, r.k, r.j) for r in want}
    for r in want:
        assert got[r.replicate, r.k, r.j] == (r.v, pytest.approx(r.a))


@pytest.mark.parametrize("scores,cut", [(3, False), (200, True)])
def test_ranges_follow_distinct_scores(spark, monkeypatch, scores, cut):
    seen, summarise = [], S.summarise_scores
    monkeypatch.setattr(S, "summarise_scores", lambda table, groups, rows, edges: seen.append(edges) or summarise(table, groups, rows, edges))
    df = spark.createDataFrame([(i % 20, (i % scores) / scores, int(i % 7 == 0)) for i in range(1000)], "c int, p double, y int")
    plan = G.plan_draws(df, [], "c", 3, 1)
    small = S.replicate_metrics(df, plan, [], "p", "y", rows=50).orderBy("replicate").collect()
    assert bool(seen[0]) is cut
    whole = S.replicate_metrics(df, plan, [], "p", "y").orderBy("replicate").collect()
    assert [r.n_rows for r in small] == [1000] * 3
    for a, b in zip(small, whole, strict=True):
        assert a.auroc == pytest.approx(b.auroc) and a.auprc == pytest.approx(b.auprc)
