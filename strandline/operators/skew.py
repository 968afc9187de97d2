"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialise

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, rows: int) -> bool:
    """At most ``rows`` rows; the check reads no more than it has to."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join to a code-like table.

    The right side is broadcast only after its row count was checked;
    a larger one goes through ``spread_join``.
    """
    if fits(right, rows):
        return left.join(F.broadcast(right), on, how)
    return spread_join(left, right, on, how)


def keyed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two tables that both grow with the input.

    Neither side is broadcast: the planner takes sizes from compressed files with
    most columns left out, and such a table can be many times larger in memory.
    """
    return left.join(right.hint("merge"), on, how)


def hot_keys(df: DataFrame, on: list[str], rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Keys with more than ``rows`` rows and the number of parts to cut them into.

    ``counts`` may hand in a table (keys, n) that already exists.
    """
    counts = counts if counts is not None else df.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > rows).select(*on, F.ceil(F.col("n") / F.lit(float(rows))).cast("int").alias("_parts"))


def crowded(counts: DataFrame, on: list[str], rows: int = HOT_ROWS) -> bool:
    """Some key of ``on`` may hold more than ``rows`` rows, from a table with counts ``n``."""
    return not counts.groupBy(*on).agg(F.sum("n").alias("n")).where(F.col("n") > rows).isEmpty()


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose left side may hold very frequent keys.

    Rows of a frequent key are spread over several parts by a hash of the
    whole row; the right side repeats that key once per part.  With no frequent
    key this is a plain join.  Every row of the left side meets every matching
    row of the right side exactly once.  The frequent keys stay a table: at most
    one for every ``rows`` rows of the left side.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join keeps the left side whole and cannot do {how!r}")
    hot = materialise(hot_keys(left, on, rows, counts), "hot_keys")
    if hot.isEmpty():
        return left.join(right, on, how)
    hot = F.broadcast(hot) if fits(hot, BROADCAST_ROWS) else hot
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_left = left.join(hot, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*left.columns), parts.cast("long")).cast("int")
    )
    salted_right = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    joined = salted_left.drop("_parts").join(salted_right.drop("_parts"), [*on, "_salt"], how)
    return joined.drop("_salt")
