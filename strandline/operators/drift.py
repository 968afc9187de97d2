"""Frozen reference profiles and the change against them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import (
    bin_category,
    bin_labels,
    bin_numeric,
    event_tier,
    wilson,
    wilson_effective,
)
from strandline.layout import OTHER_LABEL, OUT_OF_RANGE_LABEL
from strandline.operators.contracts import ContractError

MAX_LEVELS = 50


@dataclass(frozen=True)
class Covariate:
    """A column watched for drift: bin edges for numbers, frozen levels for text."""

    name: str
    column: str
    edges: tuple[float, ...] = ()
    levels: tuple[str, ...] = ()

    @property
    def numeric(self) -> bool:
        return bool(self.edges)

    def labels(self) -> list[str]:
        return [*bin_labels(self.edges), OUT_OF_RANGE_LABEL] if self.numeric else [*self.levels, OTHER_LABEL]

    def label_column(self) -> Column:
        c = F.col(self.column)
        return bin_numeric(c.try_cast("double"), self.edges) if self.numeric else bin_category(c, self.levels)


def frozen_levels(df: DataFrame, column: str) -> tuple[str, ...]:
    """Observed levels in text order; more than 50 is an error."""
    found = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    levels = [r["v"] for r in found.limit(MAX_LEVELS + 1).collect()]
    if not levels or len(levels) > MAX_LEVELS:
        raise ContractError(f"{column} has {'no' if not levels else 'too many'} levels")
    return tuple(sorted(levels))


def profile(df: DataFrame, covariates: Sequence[Covariate], weight: str) -> DataFrame:
    """One row per covariate and declared level.

    Weight share of the level, missing rate, and for numbers the weighted mean
    and sd.  All covariates are read in one pass.
    """
    entries = [
        F.struct(
            F.lit(v.name).alias("covariate"),
            v.label_column().alias("level"),
            (F.col(v.column).try_cast("double") if v.numeric else F.lit(None).cast("double")).alias("value"),
            F.col(v.column).isNull().alias("missing"),
        )
        for v in covariates
    ]
    long = df.select(F.col(weight).cast("double").alias("w"), F.inline(F.array(*entries)))
    known = F.col("value").isNotNull() & ~F.isnan("value")
    if_known = lambda c: F.sum(F.when(known, c))
    per_level = long.groupBy("covariate", "level").agg(
        F.sum("w").alias("w"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("missing").alias("n_missing"),
        if_known(F.col("w")).alias("kw"),
        if_known(F.col("w") * F.col("value")).alias("kwx"),
        if_known(F.col("w") * F.col("value") * F.col("value")).alias("kwxx"),
    )
    per_covariate = per_level.groupBy("covariate").agg(
        F.sum("w").alias("_w"),
        (F.sum("n_missing") / F.sum("n")).alias("missing_rate"),
        (F.sum("kwx") / F.sum("kw")).alias("weighted_mean"),
        (F.sum("kwxx") / F.sum("kw")).alias("_second"),
    )
    declared = df.sparkSession.createDataFrame(
        [(v.name, v.column, "numeric_binned" if v.numeric else "categorical", i, label) for v in covariates for i, label in enumerate(v.labels())],
        "covariate string, source_column string, kind string, level_no int, level string",
    )
    spread = F.col("_second") - F.pow("weighted_mean", F.lit(2.0))
    variance = F.when(spread.isNotNull(), F.greatest(spread, F.lit(0.0)))
    return (
        declared.join(per_level.select("covariate", "level", "w"), ["covariate", "level"], "left")
        .join(per_covariate, "covariate")
        .select(
            "covariate", "source_column", "kind", "level_no", "level",
            F.coalesce(F.col("w") / F.col("_w"), F.lit(0.0)).alias("share"),
            "missing_rate", "weighted_mean", F.sqrt(variance).alias("weighted_sd"),
        )
    )


def covariate_drift(observed: DataFrame, reference: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Change of shares, stability index, missing rate and standardised mean per level."""
    names = ("share", "missing_rate", "weighted_mean", "weighted_sd")
    ref = reference.select("covariate", "level", *[F.col(c).alias(f"reference_{c}") for c in names])
    both = observed.join(ref, ["covariate", "level"])
    o, r = F.col("share"), F.col("reference_share")
    term = (o - r) * F.log((o + eps) / (r + eps))
    index = both.groupBy("covariate").agg(F.sum(term).alias("population_stability_index"))
    return both.join(index, "covariate").select(
        "covariate", "source_column", "kind", "level",
        r.alias("reference_share"), o.alias("observed_share"), (o - r).alias("share_change"),
        "population_stability_index",
        "reference_missing_rate", F.col("missing_rate").alias("observed_missing_rate"),
        (F.col("missing_rate") - F.col("reference_missing_rate")).alias("missing_rate_change"),
        F.col("weighted_mean").alias("observed_weighted_mean"), F.col("weighted_sd").alias("observed_weighted_sd"),
        F.try_divide(F.col("weighted_mean") - F.col("reference_weighted_mean"), F.col("reference_weighted_sd")).alias(
            "standardized_mean_difference"
        ),
    )


def labels_long(df: DataFrame, outcomes: Sequence[str], keep: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """Rows (keep.., outcome, y).  Null labels stay null and are never read as 0.

    Only outcomes named in ``nullable`` may be null, and one of those needs at
    least one known label.
    """
    known = df.agg(*[F.count(c).alias(c) for c in outcomes], F.count(F.lit(1)).alias("_n")).first()
    for c in outcomes:
        if known[c] < known["_n"] and c not in nullable:
            raise ContractError(f"outcome {c} must be fully observed")
        if not known[c]:
            raise ContractError(f"outcome {c} has no known label")
    entries = [F.struct(F.lit(c).alias("outcome"), F.col(c).cast("int").alias("y")) for c in outcomes]
    return df.select(*keep, F.inline(F.array(*entries)))


def label_rates(long: DataFrame, weight: str) -> DataFrame:
    """Plain and weighted rate per outcome with Wilson bounds; nulls are counted apart."""
    y, w = F.col("y"), F.col(weight)
    known = y.isNotNull()
    sums = long.groupBy("outcome").agg(
        F.count("y").alias("valid_n"),
        F.count_if(~known).alias("missing_n"),
        F.sum("y").alias("event_count"),
        F.sum(F.when(known, w)).alias("valid_weight"),
        F.sum(F.when(known, w * w)).alias("_ww"),
        F.sum(w * y).alias("_wy"),
    )
    plain = F.col("event_count") / F.col("valid_n")
    weighted = F.col("_wy") / F.col("valid_weight")
    lo, hi = wilson(F.col("event_count"), F.col("valid_n"))
    wlo, whi = wilson_effective(weighted, F.col("valid_weight"), F.col("_ww"))
    row = lambda name, rate, low, high: F.struct(
        F.lit(name).alias("weighting"), rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high")
    )
    return sums.select(
        "outcome", "valid_n", "missing_n", "event_count", "valid_weight",
        event_tier(F.col("event_count")).alias("event_tier"),
        F.inline(F.array(row("unweighted_rate", plain, lo, hi), row("weighted_rate", weighted, wlo, whi))),
    )


def label_drift(observed: DataFrame, reference: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Change of every rate, with resampled bounds when given (outcome, weighting, ..)."""
    keys = ["outcome", "weighting"]
    ref = reference.select(*keys, F.col("rate").alias("reference_rate"))
    out = observed.join(ref, keys).withColumn("rate_change", F.col("rate") - F.col("reference_rate"))
    return out if bounds is None else out.join(bounds, keys, "left")


def metric_drift(observed: DataFrame, reference: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long table of metrics with their change from the reference."""
    long = lambda df, name: df.select(
        *keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics]))
    )
    both = long(observed, "observed_value").join(long(reference, "reference_value"), [*keys, "metric"])
    return both.withColumn("change", F.col("observed_value") - F.col("reference_value"))


def coverage_drift(observed: DataFrame, reference: DataFrame, keys: Sequence[str], declared: DataFrame, values: Sequence[str] = ("coverage", "mean_set_size", "abstention_rate")) -> DataFrame:
    """Change per set and level.

    A reference level without rows stays as an undefined row.  A level without
    reference is reported when ``declared`` (dimension, level) lists it, and is
    an error otherwise.
    """
    ref = reference.select(*keys, *[F.col(v).alias(f"{v}_reference") for v in values], F.lit(True).alias("_ref"))
    both = observed.withColumn("_obs", F.lit(True)).join(ref, list(keys), "full_outer")
    both = both.join(declared.select("dimension", "level", F.lit(True).alias("_declared")), ["dimension", "level"], "left")
    status = (
        F.when(F.col("_obs").isNull(), "UNDEFINED_EMPTY_SUBGROUP")
        .when(F.col("_ref").isNull() & F.col("_declared"), "NO_FROZEN_REFERENCE_NEW_STRATUM")
        .when(F.col("_ref").isNull(), F.raise_error(F.concat(F.lit("undeclared level: "), F.col("dimension"), F.lit("="), F.col("level"))).cast("string"))
        .otherwise("OK")
    )
    return both.withColumns(
        {
            "status": status,
            "n_rows": F.coalesce("n_rows", F.lit(0)),
            "event_count": F.coalesce("event_count", F.lit(0)),
            **{f"{v}_change": F.col(v) - F.col(f"{v}_reference") for v in values},
        }
    ).drop("_obs", "_ref", "_declared")
