import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import isotonic as I


def plain(points):
    """Value of each score: the largest over starts of the smallest mean over ends."""
    xs = sorted(points)
    w, s = np.array([points[x][0] for x in xs]), np.array([points[x][1] for x in xs])
    cw, cs = np.concatenate([[0], w.cumsum()]), np.concatenate([[0], s.cumsum()])
    out = {}
    for k, x in enumerate(xs):
        ends = np.arange(k + 1, len(xs) + 1)
        out[x] = max(((cs[ends] - cs[i]) / (cw[ends] - cw[i])).min() for i in range(k + 1))
    return out


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "waves", "tied"])
@pytest.mark.parametrize("rows", [200_000, 4, 9])
def test_fit_against_the_definition(spark, shape, rows):
    rng = random.Random(shape)
    score = lambda i: i // 20 if shape == "tied" else i
    mean = {
        "noise": lambda i: 0.5, "falling": lambda i: 1 - i / 130, "rising": lambda i: i / 130,
        "waves": lambda i: 0.5 + 0.4 * np.sin(i / 9) + i / 400, "tied": lambda i: i / 150,
    }[shape]
    data = [(score(i) / 130, float(rng.random() < mean(i)), 1.0 + i % 3) for i in range(130)]
    points = {}
    for f, y, w in data:
        old = points.get(f, (0.0, 0.0))
        points[f] = old[0] + w, old[1] + w * y
    blocks = I.fit(spark.createDataFrame(data, "p double, y double, w double"), "p", "y", "w", rows)
    held = sorted(map(tuple, blocks.collect()))
    assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(held, held[1:]))
    got = {f: next(v for lo, hi, v in held if lo <= f <= hi) for f in points}
    assert got == pytest.approx(plain(points))


@pytest.mark.parametrize("rows", [200_000, 3])
def test_values_between_blocks_are_linear(spark, rows):
    blocks = spark.createDataFrame([(0.1, 0.2, 0.05), (0.4, 0.4, 0.5), (0.6, 0.9, 0.8)], "lo double, hi double, value double")
    ps = [0.0, 0.1, 0.15, 0.2, 0.3, 0.35, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95, 1.0] * 3 + [None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = {r.i: r.v for r in I.apply(df, blocks, "p", "v", rows).collect()}
    want = lambda p: None if p is None else np.interp(p, [0.1, 0.2, 0.4, 0.6, 0.9], [0.05, 0.05, 0.5, 0.8, 0.8])
    assert len(got) == len(ps) and all(got[i] == pytest.approx(want(p)) for i, p in enumerate(ps))


def test_no_range_holds_all_blocks(spark, monkeypatch):
    """Rising scores pool little: blocks stay about as many as scores, and no task sees more than a range."""
    seen = []
    real = I._pool_ranges

    def watched(rows):
        seen.append(rows.groupBy("range").count().agg(F.max("count")).first()[0])
        return real(rows)

    monkeypatch.setattr(I, "_pool_ranges", watched)
    df = spark.range(20_000).select((F.col("id") / 20_000).alias("p"), (F.col("id") / 20_000 + F.pmod("id", F.lit(3)) * 1e-4).alias("y"))
    blocks = I.fit(df, "p", "y", rows=1_000)
    assert blocks.count() > 5_000 and max(seen) <= 2_000


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "p double, y double")
    assert I.fit(empty, "p", "y").count() == 0
