"""Weighted one-pass aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """sum(w x) / sum(w) over rows that have a value; null without weight."""
    known = value.isNotNull()
    return F.try_divide(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)))


def weighted_sd(value: Column, weight: Column) -> Column:
    """Population standard deviation with weights."""
    spread = weighted_mean(value * value, weight) - F.pow(weighted_mean(value, weight), F.lit(2.0))
    return F.sqrt(F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0))))


def level_shares(df: DataFrame, level: str, weight: str, levels: Sequence[str]) -> DataFrame:
    """Weight share of every listed level; a level without rows has share 0."""
    found = df.groupBy(F.col(level).alias("level")).agg(F.sum(weight).alias("w"))
    total = df.agg(F.sum(weight)).first()[0]
    shares = found.select("level", F.try_divide(F.col("w"), F.lit(total).cast("double")).alias("share"))
    wanted = df.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    return wanted.join(shares, "level", "left").select("level", F.coalesce("share", F.lit(0.0)).alias("share"))


def moments(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Count, mean and population sd of the values inside [low, high]."""
    v = F.when(F.col(value).between(low, high), F.col(value).cast("double"))
    return df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def count_and_weight(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Histogram over an integer column."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))


def capped_positive_weight(positive: Column, valid: Column, cap: float = 20.0) -> Column:
    """min(cap, negatives / positives); a label with one class only is an error."""
    one_class = (positive <= 0) | (positive >= valid)
    return F.when(one_class, F.raise_error(F.lit("label has one class only")).cast("double")).otherwise(
        F.least(F.lit(cap), (valid - positive) / positive)
    )


def quality_counts(df: DataFrame, conditions: Mapping[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Number of rows per condition, all in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]]
    return df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)


def cohort_row(
    df: DataFrame,
    groups: Sequence[str],
    entity: Sequence[str],
    facility: str,
    weight: str,
    means: Mapping[str, Column],
    percents: Mapping[str, Column],
) -> DataFrame:
    """One descriptive row per cohort: sizes, repeat share, weighted means and percents."""
    n, w = F.count(F.lit(1)), F.col(weight)
    entities = F.countDistinct(*entity)
    return df.groupBy(*groups).agg(
        n.alias("episodes"),
        entities.alias("entities"),
        F.countDistinct(facility).alias("facilities"),
        (100 * (1 - entities / n)).alias("repeat_percent"),
        F.sum(w).alias("weighted_population"),
        *[weighted_mean(c, w).alias(name) for name, c in means.items()],
        *[(100 * weighted_mean(c.cast("double"), w)).alias(name) for name, c in percents.items()],
    )


def pool_rows(rows: DataFrame, sums: Sequence[str], size: str = "episodes", skip: Sequence[str] = ()) -> DataFrame:
    """One pooled row: counts are added, other columns averaged by cohort size."""
    means = [c for c in rows.columns if c not in (*sums, *skip)]
    return rows.agg(
        *[F.sum(c).alias(c) for c in sums],
        *[(F.sum(F.col(c) * F.col(size)) / F.sum(size)).alias(c) for c in means],
    )
