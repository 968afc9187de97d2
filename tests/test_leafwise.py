import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strandline.operators import leafwise as W


def table(spark, x, y, later=None):
    later = later if later is not None else np.arange(len(y)) % 4 == 0
    rows = [(i, [float(v) for v in x[i]], int(y[i]), bool(later[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, later boolean").select(
        "id", "y", "later", array_to_vector("x").alias("features")
    )


def exact_edges(spark, x):
    rows = []
    for place in range(x.shape[1]):
        edges = sorted({0.0, *map(float, x[:, place])})
        rows.append((place, edges, edges.index(0.0)))
    return spark.createDataFrame(rows, "place int, edges array<double>, zero int")


def plain_tree(x, g, h, settings):
    """Best-first growth with all cuts of all leaves tried anew at each step."""
    leaves, order = {1: np.arange(len(g))}, []
    part = lambda at: g[at].sum() ** 2 / (h[at].sum() + settings.penalty)
    while len(leaves) < settings.leaves:
        best = None
        for node, at in leaves.items():
            for place in range(x.shape[1]):
                for value in np.unique(x[at, place])[:-1]:
                    left, right = at[x[at, place] <= value], at[x[at, place] > value]
                    if min(len(left), len(right)) < settings.least_rows:
                        continue
                    gain = round(part(left) + part(right) - part(at), 9)
                    found = (gain, -node, -place, -value)
                    if gain > 1e-9 and (best is None or found > best[0]):
                        best = (found, node, left, right)
        if best is None:
            break
        _, node, left, right = best
        del leaves[node]
        leaves |= {2 * node: left, 2 * node + 1: right}
        order.append(node)
    return order, {k: len(at) for k, at in leaves.items()}


@pytest.mark.parametrize("leaves,least", [(2, 1), (6, 5), (12, 3), (40, 12)])
def test_tree_against_plain_growth(spark, leaves, least):
    rng = np.random.default_rng(leaves)
    x = np.stack([rng.integers(-3, 4, 150), rng.integers(0, 2, 150), rng.integers(0, 9, 150) / 4], axis=1).astype(float)
    y = (rng.random(150) < 1 / (1 + np.exp(-x[:, 0] + x[:, 1] * x[:, 2]))).astype(int)
    settings = W.Settings(leaves, least, penalty=1.0)
    edges = exact_edges(spark, x)
    p = 1 / (1 + np.exp(-rng.normal(size=150)))
    slopes = spark.createDataFrame([(i, float(p[i] - y[i]), float(p[i] * (1 - p[i]))) for i in range(150)], "id long, g double, h double")
    rows = W.binned(table(spark, x, y), "features", edges).join(slopes, "id")
    tree = W.grow(rows, settings)
    order, sizes = plain_tree(x, p - y, p * (1 - p), settings)
    assert list(tree.order) == order
    assert {k: s.n for k, s in tree.leaves.items()} == sizes
    placed = {r[0]: r[1] for r in rows.groupBy(W.node_of(tree.cuts).alias("node")).count().collect()}
    assert placed == sizes


def test_fit_lowers_the_loss_and_scores_as_it_was_fitted(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(600, 4)), 2)
    x[:, 3] = rng.random(600) < 0.1
    y = (rng.random(600) < 1 / (1 + np.exp(-3 * np.sign(x[:, 0] * x[:, 1])))).astype(int)
    df = table(spark, x, y)
    settings = W.Settings(8, 5, 0.5, 1.0, 0.8, 0.8, bins=31, rounds=4, patience=2)
    forest = W.fit(df, "id", "y", "later", "features", settings)
    assert 1 <= len(forest.trees) <= 4 and forest.losses[len(forest.trees) - 1] == min(forest.losses)
    scored = W.score(forest, df, "features")
    p = scored.where("later").select("y", "p").toPandas()
    loss = -(p.y * np.log(p.p) + (1 - p.y) * np.log(1 - p.p)).mean()
    assert loss == pytest.approx(min(forest.losses)) and loss < 0.66
    assert all(len(t.leaves) <= 8 and min(s.n for s in t.leaves.values()) >= 5 for t in forest.trees)


def random_rows(number, seed):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(-4, 5, number), rng.random(number) < 0.2, rng.integers(0, 9, number) / 4, rng.integers(-3, 1, number)], axis=1).astype(float)
    y = (rng.random(number) < 1 / (1 + np.exp(1 - x[:, 0] - 2 * x[:, 1] * x[:, 2]))).astype(int)
    return x, y


@pytest.mark.parametrize("tasks", [1, 5])
def test_trees_of_a_fit_are_those_grown_from_the_same_slopes(spark, monkeypatch, tasks):
    monkeypatch.setattr(W, "TASK_ROWS", 700 // tasks)
    monkeypatch.setattr(W, "JOB_TREES", 2)
    x, y = random_rows(700, 3)
    df = table(spark, x, y)
    settings = W.Settings(9, 12, 0.3, 1.0, 0.8, 0.7, bins=15, rounds=3, patience=3)
    forest = W.fit(df, "id", "y", "later", "features", settings)
    assert len(forest.losses) == 3
    rows = W.binned(df.where("not later"), "features", forest.edges).cache()
    f = {r["id"]: forest.start for r in rows.select("id").collect()}
    for number, tree in enumerate(forest.trees):
        scores = spark.createDataFrame(list(f.items()), "id long, f double")
        grown = W.grow(W.with_slopes(W.drawn(rows, 0.8, number, "id").join(scores, "id"), "y"), settings, number)
        assert tree.order == grown.order and len(tree.order) > 2
        assert {k: (c.place, c.upto, c.left.n) for k, c in tree.cuts.items()} == {k: (c.place, c.upto, c.left.n) for k, c in grown.cuts.items()}
        values, expected = tree.values(settings), grown.values(settings)
        assert values == pytest.approx(expected)
        placed = rows.select("id", W.node_of(grown.cuts).alias("node")).collect()
        f = {r["id"]: f[r["id"]] + expected[r["node"]] for r in placed}
    scored = {r["id"]: r["p"] for r in W.score(forest, df.where("not later"), "features").select("id", "p").collect()}
    assert len(forest.trees) == 3 and scored == pytest.approx({k: 1 / (1 + np.exp(-v)) for k, v in f.items()})


def test_draws_are_those_of_spark(spark):
    values = [0, 1, -1, 5, 2**31 - 1, -(2**31), 123456789]
    for kind, long in (("int", False), ("long", True)):
        wide = [*values, 2**62 + 7, -(2**63)] if long else values
        df = spark.createDataFrame([(v,) for v in wide], f"v {kind}")
        for number in (0, 3, 1599):
            got = W.drawn_values(np.array(wide, np.int64), 0.5, number, long)
            assert {v for v, k in zip(wide, got) if k} == {r["v"] for r in W.drawn(df, 0.5, number, "v").collect()}


def test_no_marked_row_stops_the_fit(spark):
    x, y = random_rows(200, 4)
    with pytest.raises(ValueError, match="validation"):
        W.fit(table(spark, x, y, np.zeros(200)), "id", "y", "later", "features", W.Settings(4, 5, rounds=3))


def test_query_fits_the_whole_setting(spark, monkeypatch):
    """Five trees at a step of 0.3 are not the setting of the grid."""
    from strandline.plans import trees

    x, y = random_rows(3000, 6)
    design = table(spark, x, y).select(F.col("id").alias("enc_id"), (1996 + F.col("id") % 5).cast("int").alias("year"), "y", "features")
    monkeypatch.setattr(trees, "full_design", lambda spark, sf_dir: design)
    fits, fit = [], W.fit
    monkeypatch.setattr(W, "fit", lambda *a: fits.append((a[-1], fit(*a))) or fits[-1][1])
    row = trees.leafwise_boosted_trees(spark, "").first()
    (settings, forest), = fits
    assert settings == W.GRID[0] == W.Settings(15, 100, 0.05, 5.0, 0.8, 1.0, 127, 1600, 75)
    assert row["trees"] == len(forest.trees) > 5 and len(forest.losses) == min(1600, len(forest.trees) + 75)


def test_sparse_and_dense_vectors_meet_the_same_bins(spark):
    from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT())])
    pairs = [(0, Vectors.dense([0.0, 2.0, -1.0])), (1, SparseVector(3, [1, 2], [2.0, -1.0])), (2, SparseVector(3, [], [])), (3, Vectors.dense([0.0, 0.0, 0.0]))]
    df = spark.createDataFrame(pairs, schema)
    edges = W.bin_edges(df, "features", 7)
    assert {r["place"]: (r["edges"], r["zero"]) for r in edges.collect()} == {1: ([0.0, 2.0], 0), 2: ([-1.0, 0.0], 1)}
    got = {r["id"]: [tuple(c) for c in r["cells"]] for r in W.binned(df, "features", edges).collect()}
    assert got == {0: [(1, 1, 0), (2, 0, 1)], 1: [(1, 1, 0), (2, 0, 1)], 2: [], 3: []}


def test_refusals(spark):
    x = np.ones((8, 1))
    with pytest.raises(ValueError, match="both kinds"):
        W.fit(table(spark, x, np.zeros(8)), "id", "y", "later", "features", W.Settings())
    df = table(spark, x, np.arange(8) % 2).withColumn("y", F.when(F.col("id") > 2, F.col("y")))
    with pytest.raises(ValueError, match="null"):
        W.fit(df, "id", "y", "later", "features", W.Settings())
