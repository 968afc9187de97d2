"""Metrics under resampled clusters, and intervals from replicates.

Draws come from ``strandline.operators.draws``: the multiplicities of a cluster
are made in the task that adds up its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.values import ratio
from strandline.operators.contracts import required
from strandline.operators.draws import Draws, added_up
from strandline.operators.metrics import confusion, operating_rates, summarise_scores
from strandline.operators.ordering import RANGE_ROWS, range_edges
from strandline.session import materialise

MEASURES = ("n", "events", "pos", "neg")


def replicate_scores(df: DataFrame, draws: Draws, groups: Sequence[str], p: str, y: str, weight: str | None = None) -> DataFrame:
    """Score table per (replicate, group).

    Rows are added up per (cluster, score) first; tasks multiply these sums with
    the multiplicities of their clusters for all replicates at once.
    """
    groups = list(groups)
    w = F.col(weight) if weight else F.lit(1.0)
    event = F.col(y) == 1
    sums = required(df, *groups, *draws.on, p, y).groupBy(*groups, *draws.on, F.col(p).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(event).alias("events"),
        F.sum(F.when(event, w).otherwise(0.0)).cast("double").alias("pos"),
        F.sum(F.when(event, 0.0).otherwise(w)).cast("double").alias("neg"),
    )
    return added_up(sums, draws, [*groups, "p"], MEASURES).where("n > 0")


def replicate_metrics(df: DataFrame, draws: Draws, groups: Sequence[str], p: str, y: str, weight: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """AUROC, average precision, Brier, log loss, rate and O/E per replicate."""
    table = materialise(replicate_scores(df, draws, groups, p, y, weight), "replicate_scores")
    # a replicate holds a score once, so its ranges follow the distinct scores, not the rows of the input
    edges = range_edges(table.select("p").distinct(), "p", rows)
    return summarise_scores(table, ["replicate", *groups], rows, edges)


def replicate_sums(df: DataFrame, draws: Draws, groups: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Weighted sums per (replicate, group): added up per cluster, then multiplied."""
    groups = list(groups)
    per_cluster = required(df, *groups, *draws.on).groupBy(*groups, *draws.on).agg(*[c.alias(n) for n, c in sums.items()])
    return added_up(per_cluster, draws, groups, list(sums))


def replicate_rates(df: DataFrame, draws: Draws, groups: Sequence[str], y: str, weight: str) -> DataFrame:
    """Plain and weighted rate of a label per replicate; null labels are left out."""
    known = df.where(F.col(y).isNotNull())
    w, v = F.col(weight), F.col(y).cast("double")
    sums = replicate_sums(
        known, draws, groups,
        {"n": F.count(F.lit(1)), "events": F.sum(v), "w": F.sum(w), "wy": F.sum(w * v)},
    )
    return sums.select(
        "replicate", *groups, "n", "w",
        (F.col("events") / F.col("n")).alias("unweighted_rate"),
        (F.col("wy") / F.col("w")).alias("weighted_rate"),
    )


def replicate_operating(df: DataFrame, draws: Draws, groups: Sequence[str], p: str, y: str, weight: str, threshold: str) -> DataFrame:
    """Operating-point rates per replicate."""
    sums = confusion(F.col(p), F.col(y), F.col(weight), F.col(threshold))
    table = replicate_sums(required(df, p, y, weight), draws, [*groups, threshold], sums)
    return table.withColumns(operating_rates(F.col(threshold)))


# inference from replicates --------------------------------------------------

def percentile_bounds(value: str, low: float = 0.025, high: float = 0.975) -> tuple[Column, Column]:
    """Aggregates over the replicates of a group (their number is bounded)."""
    v = F.when(~F.isnan(F.col(value)), F.col(value))
    return F.percentile(v, F.lit(low)), F.percentile(v, F.lit(high))


def intervals(replicates: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """2.5% and 97.5% points of every metric and the number of defined replicates."""
    aggs = []
    for v in values:
        lo, hi = percentile_bounds(v)
        aggs += [lo.alias(f"{v}_low"), hi.alias(f"{v}_high"), F.count(v).alias(f"{v}_defined")]
    by = replicates.groupBy(*groups) if groups else replicates.groupBy()
    return by.agg(*aggs)


def paired_difference(replicates: DataFrame, groups: Sequence[str], model: str, first: str, second: str, value: str) -> DataFrame:
    """value(first) - value(second) in the same replicate; null where undefined."""
    a = replicates.where(F.col(model) == first).select("replicate", *groups, F.col(value).alias("_a"))
    b = replicates.where(F.col(model) == second).select("replicate", *groups, F.col(value).alias("_b"))
    return a.join(b, ["replicate", *groups]).select("replicate", *groups, (F.col("_a") - F.col("_b")).alias("difference"))


def max_t(replicates: DataFrame, points: DataFrame, family: str, value: str = "difference") -> DataFrame:
    """Simultaneous intervals over a family of contrasts.

    ``replicates`` holds (replicate, family, value) and ``points`` (family,
    estimate).  The critical value is the 95% point of the largest absolute
    t over the family, taken replicate by replicate.
    """
    spread = replicates.groupBy(family).agg(F.stddev_samp(value).alias("se"))
    base = points.join(spread, family)
    t = replicates.join(base, family).withColumn("_t", F.abs(ratio(F.col(value) - F.col("estimate"), F.col("se"))))
    largest = t.groupBy("replicate").agg(F.max("_t").alias("_max"))
    critical = largest.agg(F.percentile("_max", F.lit(0.95)).alias("c"), F.count(F.lit(1)).alias("r")).first()
    observed = base.withColumn("_obs", F.abs(ratio(F.col("estimate"), F.col("se"))))
    # replicates of a family are few; one row per (replicate, contrast)
    exceed = (
        t.select("replicate", family).join(largest, "replicate").join(observed.select(family, "_obs"), family)
        .groupBy(family).agg(F.count_if(F.col("_max") >= F.col("_obs")).alias("_k"))
    )
    half = F.lit(critical["c"]) * F.col("se")
    return observed.join(exceed, family).select(
        family, "estimate", "se",
        F.lit(critical["c"]).alias("critical"),
        (F.col("estimate") - half).alias("low"),
        (F.col("estimate") + half).alias("high"),
        ((F.col("_k") + 1) / F.lit(critical["r"] + 1)).alias("adjusted_p"),
    )


def two_sided_p(replicates: DataFrame, groups: Sequence[str], value: str = "difference") -> DataFrame:
    """Twice the smaller tail, each tail counted with one more."""
    n = F.count(F.lit(1)) + 1
    low = (F.count_if(F.col(value) <= 0) + 1) / n
    high = (F.count_if(F.col(value) >= 0) + 1) / n
    return replicates.groupBy(*groups).agg(F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))


def holm(tests: DataFrame, family: Sequence[str], p: str, name: str, out: str = "adjusted_p") -> DataFrame:
    """Step-down adjustment inside each family of tests (a short list)."""
    keys = list(family)
    by = Window.partitionBy(*keys)
    ranked = by.orderBy(p, name)
    m, rank = F.count(F.lit(1)).over(by), F.row_number().over(ranked)
    scaled = tests.withColumn("_s", (m - rank + 1) * F.col(p))
    running = ranked.rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(running))).drop("_s")
