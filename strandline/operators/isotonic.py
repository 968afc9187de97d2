"""Isotonic fit whose pooled blocks are never in one place.

The fit is the slope of the greatest convex minorant of the running sums.  Distinct
scores are cut into ranges and neighbours that violate the order are pooled inside
each range.  The blocks that are left are numbered and cut anew, every second time
half a range further on, until no two neighbours violate the order: whatever two
blocks still do is then in one range, and pooled.  Each round only reads what the
last one left, and a task holds one range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.contracts import required
from strandline.operators.ordering import RANGE_ROWS, range_edges, with_range
from strandline.operators.skew import lookup_join
from strandline.session import materialise, ship

BLOCKS = "lo double, hi double, w double, s double, range long, place long"


def pooled(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order whose means rise strictly, from blocks in order."""
    firsts, weights, sums = [], [], []
    for at, (weight, total) in enumerate(zip(w.tolist(), s.tolist())):
        first = at
        # equal means are one block as well; products spare the division
        while sums and sums[-1] * weight >= total * weights[-1]:
            weight, total, first = weight + weights.pop(), total + sums.pop(), firsts.pop()
        firsts.append(first)
        weights.append(weight)
        sums.append(total)
    starts = np.array(firsts, np.int64)
    ends = np.append(starts[1:], len(lo)) - 1
    return lo[starts], hi[ends], np.array(weights), np.array(sums)


def _pool_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` (lo, hi, w, s, range), pooled range by range; ``place`` counts the blocks of a range."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        found = pooled(*[table.column(c).to_numpy() for c in ("lo", "hi", "w", "s")])
        n = len(found[0])
        return pa.table([*map(pa.array, found), pa.array(np.full(n, table.column("range")[0].as_py())), pa.array(np.arange(n))], names=["lo", "hi", "w", "s", "range", "place"])

    ship(rows.sparkSession)
    return rows.groupBy("range").applyInArrow(work, BLOCKS)


def _numbered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with their position ``at`` in the order of scores, from the number of blocks of each range."""
    sizes = blocks.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return blocks.join(offsets, "range").withColumn("at", F.col("offset") + F.col("place"))


def _violations(blocks: DataFrame) -> bool:
    """Do the ends of neighbouring ranges violate the order?  Inside a range nothing does."""
    ends = blocks.groupBy("range").agg(
        F.min_by(F.struct("w", "s"), "place").alias("first"), F.max_by(F.struct("w", "s"), "place").alias("last")
    )
    order = Window.orderBy("range")  # one row a range
    pairs = ends.select(F.lag("last").over(order).alias("a"), F.col("first").alias("b")).where("a IS NOT NULL")
    return not pairs.where("a.s * b.w >= b.s * a.w").isEmpty()


def fit(df: DataFrame, p: str, y: str, weight: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """(lo, hi, value): the rising steps of the fit of ``y`` on ``p``, by score."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = required(df, p, y).groupBy(F.col(p).cast("double").alias("f")).agg(
        F.sum(w).alias("w"), F.sum(w * F.col(y)).cast("double").alias("s")
    )
    points = materialise(points.where("w > 0"), "scores")
    cut = with_range(points, "f", range_edges(points, "f", rows), "range")
    blocks = cut.select(F.col("f").alias("lo"), F.col("f").alias("hi"), "w", "s", F.col("range").cast("long").alias("range"))
    blocks, shifted = materialise(_pool_ranges(blocks), "blocks"), True
    while _violations(blocks):
        moved = F.floor((F.col("at") + (rows // 2 if shifted else 0)) / rows)
        again = _numbered(blocks).select("lo", "hi", "w", "s", moved.alias("range"))
        blocks, shifted = materialise(_pool_ranges(again), "blocks"), not shifted
    return blocks.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"))


def _nearest(values: DataFrame, blocks: DataFrame, edges: list[str], up: bool) -> DataFrame:
    """(f, b): the last block that begins at or below f, or the first one that ends at or above it."""
    end = F.col("lo" if up else "hi")
    marks = blocks.select(end.alias("f"), F.struct("lo", "hi", "value").alias("b")).unionByName(
        values.select("f").withColumn("b", F.lit(None).cast("struct<lo:double,hi:double,value:double>"))
    )
    marks = with_range(marks, "f", edges, "range")
    way = (lambda c: F.col(c).asc()) if up else (lambda c: F.col(c).desc())
    # at equal scores the block comes first
    inside = Window.partitionBy("range").orderBy(way("f"), F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max_by if up else F.min_by
    ends = marks.groupBy("range").agg(pick("b", F.when(F.col("b").isNotNull(), F.col("f"))).alias("e"))
    across = Window.orderBy(way("range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = ends.select("range", F.last("e", ignorenulls=True).over(across).alias("carried"))
    found = marks.withColumn("own", F.last("b", ignorenulls=True).over(inside)).where("b IS NULL")
    return lookup_join(found, carried, ["range"], "left").select("f", F.coalesce("own", "carried").alias("b"))


def apply(df: DataFrame, blocks: DataFrame, p: str, out: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Add the fitted value: constant inside a block, linear between two, and the end value outside.

    Values are looked up once for each distinct score.
    """
    values = materialise(df.where(F.col(p).isNotNull()).select(F.col(p).cast("double").alias("f")).distinct(), "values")
    edges = range_edges(values, "f", rows)
    low = _nearest(values, blocks, edges, True).withColumnRenamed("b", "a")
    both = low.join(_nearest(values, blocks, edges, False), "f")
    a, b = F.col("a"), F.col("b")
    share = (F.col("f") - a["hi"]) / (b["lo"] - a["hi"])
    between = a["value"] + (b["value"] - a["value"]) * share
    value = F.when(a.isNull(), b["value"]).when(b.isNull() | (F.col("f") <= a["hi"]), a["value"]).otherwise(between)
    known = materialise(both.select(F.col("f").alias("_f"), value.alias(out)), "calibrated")
    return lookup_join(df.withColumn("_f", F.col(p).cast("double")), known, ["_f"], "left").drop("_f")
