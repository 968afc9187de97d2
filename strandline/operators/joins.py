"""Joins with a checked contract, and comparisons of two tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import keyed_join


class JoinContractError(ValueError):
    """Keys are not unique, lack a partner, or disagree."""


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    cardinality: str = "one_to_one",
    agree: Sequence[str] = (),
    orphans: bool = False,
    within: Column | None = None,
) -> DataFrame:
    """Left join that fails on duplicate keys, orphans or disagreeing columns.

    ``cardinality`` is ``one_to_one`` or ``many_to_one``.  ``agree`` names columns
    both sides hold and must agree on; ``orphans`` allows left rows without a
    partner.  ``within`` is a condition every partner meets: all keys of the right side
    are checked, but only rows that meet it are moved.
    """
    on = list(on)
    sides = [("right", right)] + ([("left", left)] if cardinality == "one_to_one" else [])
    for name, side in sides:
        if not duplicate_keys(side, on).isEmpty():
            raise JoinContractError(f"{name} side repeats a key of {on}")
    right = right if within is None else right.where(within)
    marked = right.withColumnsRenamed({c: f"_right_{c}" for c in agree}).withColumn("_found", F.lit(True))
    joined = keyed_join(left, marked, on, "left")
    bad = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_right_{c}")) & F.col("_found")).alias(c) for c in agree]
    found = joined.agg(F.count_if(F.col("_found").isNull()).alias("_orphans"), *bad).first()
    if found["_orphans"] and not orphans:
        raise JoinContractError(f"{found['_orphans']} rows have no partner on {on}")
    for c in agree:
        if found[c]:
            raise JoinContractError(f"{found[c]} rows disagree on {c}")
    return joined.drop("_found", *[f"_right_{c}" for c in agree])


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Both tables hold the same rows, counting repetitions."""
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Counts of a rebuilt table against a published one.

    One full join gives the sizes, keys missing on either side and rows whose
    labels differ.
    """
    a = left.select(*on, *[F.col(c).alias(f"_a_{c}") for c in labels], F.lit(1).alias("_a"))
    b = right.select(*on, *[F.col(c).alias(f"_b_{c}") for c in labels], F.lit(1).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differs: Column = reduce(
        lambda x, y: x | y, [~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in labels], F.lit(False)
    )
    return a.join(b, list(on), "full_outer").agg(
        F.count("_a").alias("left_n"),
        F.count("_b").alias("right_n"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("key_mismatch_n"),
        F.count_if(both & differs).alias("label_mismatch_n"),
    )
