"""Weighted evaluation of binary scores.

Rows are first collapsed to one row per (group, score); every metric is then
a sum over that table, with running totals where the order of scores matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import clip, ratio
from strandline.operators.contracts import required
from strandline.operators.ordering import (
    RANGE_ROWS,
    midpoint_quantiles,
    order_number,
    running_rows,
    running_totals,
    with_range,
)
from strandline.operators.skew import lookup_join
from strandline.session import materialise

FIT_STEPS = 3  # Newton steps between two written states


def scores_long(df: DataFrame, keep: Sequence[str], pairs: Mapping[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """Wide score table to rows (keep.., model, outcome, y, p).

    ``pairs`` maps (model, outcome) to the columns (outcome, probability).
    """
    entries = [
        F.struct(
            F.lit(model).alias("model"),
            F.lit(outcome).alias("outcome"),
            F.col(y).cast("int").alias("y"),
            F.col(p).cast("double").alias("p"),
        )
        for (model, outcome), (y, p) in pairs.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def subgroups_long(df: DataFrame, keep: Sequence[str], dimensions: Mapping[str, Column]) -> DataFrame:
    """Repeat each row once per subgroup dimension, as (dimension, level)."""
    entries = [
        F.struct(F.lit(name).alias("dimension"), F.coalesce(c.cast("string"), F.lit("<MISSING>")).alias("level"))
        for name, c in dimensions.items()
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def weightings_long(df: DataFrame, keep: Sequence[str], weight: str) -> DataFrame:
    """Repeat each row unweighted and weighted, as (weighting, w)."""
    entries = [
        F.struct(F.lit("unweighted").alias("weighting"), F.lit(1.0).alias("w")),
        F.struct(F.lit("weighted").alias("weighting"), F.col(weight).cast("double").alias("w")),
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def score_table(df: DataFrame, groups: Sequence[str], p: str, y: str, weight: str | None = None) -> DataFrame:
    """One row per (group, score): rows, events and their weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    event = F.col(y) == 1
    return required(df, *groups, p, y).groupBy(*groups, F.col(p).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(event).alias("events"),
        F.sum(F.when(event, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(event, 0.0).otherwise(w)).alias("neg"),
    )


def summarise_scores(table: DataFrame, groups: Sequence[str], rows: int = RANGE_ROWS, edges: Sequence[str | float] | None = None, eps: float = 1e-15) -> DataFrame:
    """Discrimination and error metrics from a score table.

    AUROC counts ties half; average precision steps once per distinct score.
    Both are null when a group has one class only.
    """
    groups = list(groups)
    down = table.withColumn("_neg", -F.col("p")).withColumn("all", F.col("pos") + F.col("neg"))
    if edges is not None:
        edges = sorted(-float(e) for e in edges)
    cum = running_totals(down, groups, "_neg", ["pos", "neg", "all"], rows, edges)
    p, q = F.col("p"), clip(F.col("p"), eps)
    pos, neg = F.col("pos"), F.col("neg")
    loss = -(pos * F.log(q) + neg * F.log(1 - q))
    above = F.sum(pos * (F.col("cum_neg") - neg / 2))
    sums = cum.groupBy(*groups) if groups else cum.groupBy()
    out = sums.agg(
        F.sum("n").alias("n_rows"),
        F.sum("events").alias("event_count"),
        F.sum(F.col("all")).alias("weight_sum"),
        F.sum(pos).alias("weighted_event_count"),
        F.sum(neg).alias("_neg_sum"),
        above.alias("_above"),
        F.sum(F.when(pos > 0, pos * F.col("cum_pos") / F.col("cum_all"))).alias("_steps"),
        F.sum(pos * F.pow(p - 1, 2) + neg * F.pow(p, 2)).alias("_sq"),
        F.sum(loss).alias("_loss"),
        F.sum(p * F.col("all")).alias("_exp"),
    )
    both = (F.col("weighted_event_count") > 0) & (F.col("_neg_sum") > 0)
    total, events = F.col("weight_sum"), F.col("weighted_event_count")
    return out.select(
        *groups,
        "n_rows",
        "event_count",
        "weight_sum",
        "weighted_event_count",
        ratio(events, total).alias("prevalence"),
        F.when(both, 1 - F.col("_above") / (events * F.col("_neg_sum"))).alias("auroc"),
        F.when(both, F.col("_steps") / events).alias("auprc"),
        ratio(F.col("_sq"), total).alias("brier"),
        ratio(F.col("_loss"), total).alias("log_loss"),
        ratio(events, F.col("_exp")).alias("observed_expected"),
        F.when(both, "OK").otherwise("UNDEFINED_SINGLE_OUTCOME_CLASS").alias("status"),
    )


def binary_metrics(df: DataFrame, groups: Sequence[str], p: str, y: str, weight: str | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """All threshold-free metrics of every group."""
    return summarise_scores(materialise(score_table(df, groups, p, y, weight), "scores"), groups, rows)


# order-dependent variants ---------------------------------------------------

def auroc_row_order(df: DataFrame, groups: Sequence[str], p: str, y: str, weight: str, tie: str) -> DataFrame:
    """AUROC of sorted rows: equal scores are told apart by ``tie``."""
    w = F.col(weight).cast("double")
    marked = df.select(
        *groups, F.col(p).alias("_p"), F.col(tie).alias("_tie"),
        F.when(F.col(y) == 1, w).otherwise(0.0).alias("pos"),
        F.when(F.col(y) == 1, 0.0).otherwise(w).alias("neg"),
    )
    cum = running_rows(marked, groups, ["_p"], "_tie", ["neg"])
    below = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return cum.groupBy(*groups).agg(ratio(below, F.sum("pos") * F.sum("neg")).alias("auroc"))


def average_precision_rows(df: DataFrame, groups: Sequence[str], p: str, y: str, tie: str, positives_first: bool = False) -> DataFrame:
    """Unweighted average precision that steps once per row.

    Equal scores follow ``tie``; with ``positives_first`` all events of a score
    come before its non-events.
    """
    marked = df.select(
        *groups, (-F.col(p)).alias("_neg"), (-F.col(y)).alias("_last"), F.col(tie).alias("_tie"),
        F.col(y).cast("long").alias("pos"), F.lit(1).cast("long").alias("one"),
    )
    lead = ["_neg", "_last"] if positives_first else ["_neg"]
    cum = running_rows(marked, groups, lead, "_tie", ["pos", "one"])
    steps = F.sum(F.when(F.col("pos") == 1, F.col("cum_pos") / F.col("cum_one")))
    return cum.groupBy(*groups).agg(ratio(steps, F.sum("pos")).alias("average_precision"))


# calibration ----------------------------------------------------------------

def fit_logit(table: DataFrame, groups: Sequence[str], eps: float = 1e-7, steps: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """Intercept and slope of y on logit(p), one unpenalised fit per group.

    ``table`` is a score table.  Each Newton step is one grouped aggregate of
    five sums.  The state of the groups is a table, written every few steps, and
    the loop ends when no group is open.  Groups that cannot be identified get
    nulls.
    """
    groups = list(groups)
    keys = groups or ["_all"]
    table = table if groups else table.withColumn("_all", F.lit(0))
    q = clip(F.col("p"), eps)
    points = materialise(
        table.select(*keys, F.log(q / (1 - q)).alias("x"), "pos", "neg").where(F.col("pos") + F.col("neg") > 0),
        "logits",
    )
    x = F.col("x")
    mu = 1 / (1 + F.exp(-F.least(F.greatest(F.col("b0") + F.col("b1") * x, F.lit(-35.0)), F.lit(35.0))))
    weight = F.col("pos") + F.col("neg")
    rest = F.col("pos") - weight * F.col("mu")
    curve = weight * F.greatest(F.col("mu") * (1 - F.col("mu")), F.lit(1e-12))
    det = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
    moved = [
        (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / F.col("det"),
        (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / F.col("det"),
    ]
    status = F.when(F.col("d0").isNull(), "UNIDENTIFIED").when(F.greatest(F.abs("d0"), F.abs("d1")) < tolerance, "OK")

    def step(state: DataFrame) -> DataFrame:
        """One more step for groups without a status."""
        sums = (
            lookup_join(points, state.where("status IS NULL"), keys, "inner")
            .withColumn("mu", mu)
            .groupBy(*keys, "b0", "b1")
            .agg(
                F.sum(rest).alias("g0"), F.sum(rest * x).alias("g1"),
                F.sum(curve).alias("h00"), F.sum(curve * x).alias("h01"), F.sum(curve * x * x).alias("h11"),
            )
            .withColumn("det", F.when(det > 1e-12, det))
            .withColumns({"d0": moved[0], "d1": moved[1]})
            .withColumns({"b0": F.col("b0") + F.col("d0"), "b1": F.col("b1") + F.col("d1"), "status": status})
        )
        return state.where("status IS NOT NULL").unionByName(sums.select(*state.columns))

    state = points.select(*keys).distinct().withColumns({"b0": F.lit(0.0), "b1": F.lit(1.0), "status": F.lit(None).cast("string")})
    state = materialise(state, "newton")
    for done in range(0, steps, FIT_STEPS):
        if state.where("status IS NULL").isEmpty():
            break
        for _ in range(min(FIT_STEPS, steps - done)):
            state = step(state)
        state = materialise(state, "newton")
    found = F.col("status") == "OK"
    return state.select(
        *groups,
        F.when(found, F.col("b0")).alias("calibration_intercept"),
        F.when(found, F.col("b1")).alias("calibration_slope"),
        F.coalesce("status", F.lit("NOT_CONVERGED")).alias("calibration_status"),
    )


def decile_cuts(df: DataFrame, groups: Sequence[str], p: str, weight: str, tie: str, bins: int = 10) -> DataFrame:
    """Inner cut points per group: distinct weighted quantiles without the two ends."""
    qs = [i / bins for i in range(bins + 1)]
    cuts = midpoint_quantiles(df, groups, p, weight, tie, qs, "cuts")
    inner = F.array_sort(F.array_distinct("cuts"))
    return cuts.select(
        *groups, F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0))).alias("cuts")
    )


def with_weighted_bin(df: DataFrame, groups: Sequence[str], p: str, weight: str, tie: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Add the 1-based weighted-quantile bin of each row; bins are closed on the right."""
    groups = list(groups)
    cuts = decile_cuts(df, groups, p, weight, tie, bins)
    if groups:
        joined = lookup_join(df, cuts, groups, "left")
    else:
        row = cuts.first()
        joined = df.withColumn("cuts", F.lit(row["cuts"]))
    number = F.size(F.filter("cuts", lambda c: c < F.col(p))) + 1
    return joined.withColumn(out, number).drop("cuts")


def bin_summary(binned: DataFrame, groups: Sequence[str], p: str, y: str, weight: str, bin_: str = "bin") -> DataFrame:
    """Predicted and observed weighted mean per bin."""
    w = F.col(weight)
    return required(binned, *groups, bin_, p, y, weight).groupBy(*groups, bin_).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("weight_sum"),
        (F.sum(w * F.col(p)) / F.sum(w)).alias("predicted"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("observed"),
    )


def integrated_calibration_error(summary: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Weighted mean absolute gap over bins; null with fewer than two bins."""
    gap = F.col("weight_sum") * F.abs(F.col("observed") - F.col("predicted"))
    value = F.sum(gap) / F.sum("weight_sum")
    by = summary.groupBy(*groups) if groups else summary.groupBy()
    return by.agg(F.when(F.count(F.lit(1)) >= 2, value).alias("ici"))


def with_equal_count_bin(df: DataFrame, groups: Sequence[str], p: str, tie: str, bins: int = 10, out: str = "bin") -> DataFrame:
    """Add the 1-based bin of equally many rows, in the order (p, tie).

    Row i of n (from 0) lies in bin ceil(bins * i / (n - 1)), the first row in bin 1.
    """
    groups = list(groups)
    numbered = order_number(df, groups, [p], tie, "_i")
    if groups:
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        sized = lookup_join(numbered, sizes, groups, "left")
    else:
        sized = numbered.withColumn("_n", F.lit(df.count()))
    number = F.ceil((F.col("_i") - 1) * bins / F.greatest(F.col("_n") - 1, F.lit(1)))
    return sized.withColumn(out, F.greatest(number, F.lit(1)).cast("int")).drop("_i", "_n")


# operating points -----------------------------------------------------------

def confusion(p: Column, y: Column, weight: Column, threshold: Column) -> dict[str, Column]:
    """Aggregates tp, fp, tn, fn at a threshold."""
    flagged, event = p >= threshold, y == 1
    total = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    return {
        "tp": total(flagged & event),
        "fp": total(flagged & ~event),
        "tn": total(~flagged & ~event),
        "fn": total(~flagged & event),
    }


def operating_rates(threshold: Column) -> dict[str, Column]:
    """Rates from columns tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return {
        "flagged_fraction": ratio(tp + fp, n),
        "sensitivity": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "ppv": ratio(tp, tp + fp),
        "npv": ratio(tn, tn + fn),
        "flagged_per_1000": ratio(1000 * (tp + fp), n),
        "net_benefit": ratio(tp - fp * threshold / (1 - threshold), n),
    }


def threshold_report(df: DataFrame, groups: Sequence[str], p: str, y: str, weight: str, threshold: str) -> DataFrame:
    """Confusion weights and rates per group; ``threshold`` is a column of the group."""
    sums = confusion(F.col(p), F.col(y), F.col(weight), F.col(threshold))
    out = required(df, *groups, threshold, p, y, weight).groupBy(*groups, threshold).agg(*[c.alias(n) for n, c in sums.items()])
    return out.withColumns(operating_rates(F.col(threshold)))


def decision_curve(df: DataFrame, groups: Sequence[str], p: str, y: str, weight: str, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit of the score, of treating all and of treating none.

    Each row is counted once, under the number of thresholds it reaches; the
    curve then adds up that short table.
    """
    groups, steps = list(groups), sorted(thresholds)
    event, w = F.col(y) == 1, F.col(weight)
    reached = with_range(required(df, *groups, p, y, weight).withColumn(p, F.col(p).cast("double")), p, steps, "_reached")
    counted = reached.groupBy(*groups, "_reached").agg(
        F.sum(F.when(event, w).otherwise(0.0)).alias("pos"), F.sum(F.when(event, 0.0).otherwise(w)).alias("neg")
    )
    points = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(steps)])
    table = counted.select("*", F.inline(points))
    flagged = F.col("_reached") >= F.col("step")
    t = F.col("threshold")
    odds = t / (1 - t)
    out = table.groupBy(*groups, "threshold").agg(
        F.sum(F.when(flagged, F.col("pos")).otherwise(0.0)).alias("tp"),
        F.sum(F.when(flagged, F.col("neg")).otherwise(0.0)).alias("fp"),
        F.sum("pos").alias("pos"),
        F.sum(F.col("pos") + F.col("neg")).alias("total"),
    )
    event_share = F.col("pos") / F.col("total")
    return out.select(
        *groups,
        "threshold",
        ((F.col("tp") - F.col("fp") * odds) / F.col("total")).alias("net_benefit"),
        (event_share - (1 - event_share) * odds).alias("treat_all_net_benefit"),
        F.lit(0.0).alias("treat_none_net_benefit"),
    )


def selection_score(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Mean average precision and mean Brier of each model over its outcomes."""
    return metrics.groupBy(model).agg(F.avg("auprc").alias("mean_auprc"), F.avg("brier").alias("mean_brier"))


def score_audit(
    df: DataFrame, groups: Sequence[str], key: str, p: str, y: str, flagged: str, expected_rows: int, expected_groups: int, share: float
) -> DataFrame:
    """Gates on stored scores, one row per group, with the names of those that fail.

    Rows must be as many as expected and keys distinct; scores finite, in range and
    not constant; exactly ceil(share n) rows flagged; AUROC above one half and
    average precision above the event rate.  The number of groups must be the
    expected one as well.
    """
    groups = list(groups)
    v = F.col(p).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    base = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.every(finite).alias("finite"),
        F.every(F.coalesce((v >= 0) & (v <= 1), F.lit(False))).alias("in_range"),
        F.stddev_pop(v).alias("sd"),
        F.count_if(F.col(flagged)).alias("flagged_rows"),
    )
    # a key that repeats is found by its count, not by a list of keys
    keys = df.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("n")).groupBy(*groups).agg(F.sum(F.col("n") - 1).alias("repeated_keys"))
    ranks = binary_metrics(df.where(finite), groups, p, y).select(*groups, "auroc", "auprc", "prevalence")
    found = base.join(keys, groups).join(ranks, groups, "left")
    n_groups = base.count()
    exact = F.col("flagged_rows") == F.ceil(F.col("n_rows") * F.lit(share))
    gates = {
        "row_count": F.col("n_rows") == expected_rows,
        "score_columns": F.lit(n_groups == expected_groups),
        "repeated_keys": F.col("repeated_keys") == 0,
        "not_finite": F.col("finite"),
        "out_of_range": F.col("in_range"),
        "constant": F.col("finite") & (F.col("sd") > 1e-8),
        "capacity": exact,
        "direction": (F.col("auroc") > 0.5) & (F.col("auprc") > F.col("prevalence")),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(gate, F.lit(False)), F.lit(name)) for name, gate in gates.items()]))
    return found.select(
        *groups, "n_rows", "repeated_keys", "finite", "in_range", "sd", "flagged_rows", "auroc", "auprc", "prevalence",
        F.array_join(failed, ";").alias("failures"),
    )
