"""Frozen scaling and one-hot state, fitted on development rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.layout import MISSING_LEVEL, UNSEEN_LEVEL
from strandline.operators.ordering import linear_quantile


@dataclass(frozen=True)
class NumericState:
    column: str
    median: float
    mean: float
    scale: float


def _finite(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def fit_numeric(df: DataFrame, columns: Sequence[str]) -> dict[str, NumericState]:
    """Median of the finite values, and mean and population sd after filling gaps with it.

    A nearly constant column gets scale 1, a column without values median 0.
    """
    entries = [F.struct(F.lit(c).alias("column"), _finite(F.col(c)).alias("v")) for c in columns]
    long = df.select(F.inline(F.array(*entries)))
    medians = {
        r["column"]: r["value"]
        for r in linear_quantile(long.where(F.col("v").isNotNull()), ["column"], "v", 0.5).collect()
    }
    filled = {c: F.coalesce(_finite(F.col(c)), F.lit(float(medians.get(c, 0.0)))) for c in columns}
    stats = df.agg(
        *[F.avg(v).alias(f"mean_{c}") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"sd_{c}") for c, v in filled.items()],
    ).first()
    state = {}
    for c in columns:
        sd = stats[f"sd_{c}"] or 0.0
        state[c] = NumericState(c, float(medians.get(c, 0.0)), float(stats[f"mean_{c}"] or 0.0), sd if sd > 1e-8 else 1.0)
    return state


def scaled(state: NumericState, centre: str = "median") -> tuple[Column, Column]:
    """Scaled value with gaps filled by the median, and the missing flag."""
    raw = _finite(F.col(state.column))
    middle = state.median if centre == "median" else state.mean
    value = (F.coalesce(raw, F.lit(state.median)) - F.lit(middle)) / F.lit(state.scale)
    return value, raw.isNull().cast("double")


def fit_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """All observed levels of each column in text order; they are part of the model."""
    return {
        c: tuple(r["v"] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v").collect())
        for c in columns
    }


def frozen_level(column: str, levels: Sequence[str]) -> Column:
    """The level as text; a null is the missing level, any other new value the unseen one."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_LEVEL))
    return F.when(text.isin(list(levels)) | (text == MISSING_LEVEL), text).otherwise(UNSEEN_LEVEL)


def one_hot(column: str, levels: Sequence[str]) -> Column:
    """Array over the frozen levels in text order, then missing, then unseen."""
    seen = frozen_level(column, levels)
    return F.array(*[(seen == level).cast("double") for level in (*levels, MISSING_LEVEL, UNSEEN_LEVEL)])


def static_vector(numeric: dict[str, NumericState], levels: dict[str, Sequence[str]], centre: str = "median") -> Column:
    """All scaled numbers with flags, then all one-hot blocks, as one array."""
    numbers = [c for state in numeric.values() for c in scaled(state, centre)]
    blocks = [one_hot(c, found) for c, found in levels.items()]
    return F.concat(F.array(*numbers), *blocks) if numbers else F.concat(*blocks)
