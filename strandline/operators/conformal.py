"""Split-conformal prediction sets over a short list of classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import event_tier, mask_has, mask_single, ratio, wilson
from strandline.operators.metrics import subgroups_long
from strandline.operators.ordering import RANGE_ROWS, order_statistics
from strandline.operators.skew import lookup_join

GLOBAL = "ALL"


def normalise_scores(scores: Sequence[Column]) -> Column:
    """Class scores as an array that sums to 1; invalid rows are an error."""
    values = F.array(*[c.cast("double") for c in scores])
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x == float("inf")))
    checked = F.when(
        bad | (total <= 0), F.raise_error(F.lit("class scores must be finite, non-negative and have mass")).cast("double")
    ).otherwise(total)
    return F.transform(values, lambda x: x / checked)


def nonconformity(probabilities: Column, truth: Column) -> Column:
    """1 - p(true class); classes count from 0."""
    return 1 - F.get(probabilities, truth)


def sample_rank(n: Column, alpha: float) -> Column:
    return F.least(n, F.ceil((n + 1) * F.lit(1.0 - alpha)))


def cutoffs(
    df: DataFrame, score: str, dimensions: Mapping[str, Column], alphas: Sequence[float], min_rows: int = 200, rows: int = RANGE_ROWS
) -> DataFrame:
    """Cutoff per (dimension, level, alpha).

    The dimension ``ALL`` holds the global cutoff; a level with fewer than
    ``min_rows`` rows takes that one, and says so in ``status``.
    """
    every = {GLOBAL: F.lit(GLOBAL), **dimensions}
    long = subgroups_long(df, [score], every)
    names = {a: f"q{i}" for i, a in enumerate(alphas)}
    ranks = {name: (lambda n, a=a: sample_rank(n, a)) for a, name in names.items()}
    found = order_statistics(long, ["dimension", "level"], score, ranks, rows)
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(n).alias("q")) for a, n in names.items()])
    table = found.select("dimension", "level", "n", F.inline(pairs))
    whole = table.where(F.col("dimension") == GLOBAL).select("alpha", F.col("q").alias("_global"))
    small = (F.col("n") < min_rows) & (F.col("dimension") != GLOBAL)
    return lookup_join(table, whole, ["alpha"], "inner").select(
        "dimension",
        "level",
        "alpha",
        "n",
        F.when(small, F.col("_global")).otherwise(F.col("q")).alias("q"),
        F.when(small, "GLOBAL_FALLBACK_SMALL_CALIBRATION_GROUP").otherwise("CALIBRATED").alias("status"),
    )


def argmax_index(probabilities: Column) -> Column:
    """Index of the largest entry, the first one at ties."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def set_mask(probabilities: Column, q: Column, classes: int = 5) -> Column:
    """Classes with p >= 1 - q as a bit mask; an empty set takes the largest class."""
    chosen = F.lit(0)
    for k in range(classes):
        chosen = chosen + F.when(F.get(probabilities, F.lit(k)) >= 1 - q, F.lit(1 << k)).otherwise(F.lit(0))
    return F.when(chosen > 0, chosen).otherwise(F.pow(F.lit(2.0), argmax_index(probabilities))).cast("int")


def set_columns(mask: Column, truth: Column | None = None) -> dict[str, Column]:
    """Size, parent and class of a set, and whether it covers the truth."""
    out = {
        "set_size": F.bit_count(mask).cast("int"),
        "includes_parent": mask.bitwiseAND(F.lit(~1)) != 0,
        "single_class": mask_single(mask),
    }
    if truth is not None:
        out["covered"] = mask_has(mask, truth)
    return out


def abstains(mask: Column, binary_p: Column, threshold: Column | float) -> tuple[Column, Column]:
    """(abstain, conflict): not a single class, or a class that contradicts the binary flag."""
    flagged = binary_p >= threshold
    lowest = F.log2((mask.bitwiseAND(-mask)).cast("double")).cast("int")
    conflict = ((lowest == 0) & flagged) | ((lowest > 0) & ~flagged)
    return ~((F.bit_count(mask) == 1) & ~conflict), conflict


def with_sets(df: DataFrame, probabilities: str, cut: DataFrame, dimension: str, level: Column, alpha: float, out: str, classes: int = 5) -> DataFrame:
    """Add the set mask of one dimension; a level unknown to the cutoffs takes the global one."""
    at = cut.where(F.col("alpha") == alpha)
    q_global = at.where(F.col("dimension") == GLOBAL).first()["q"]
    own = at.where(F.col("dimension") == dimension).select(F.col("level").alias("_level"), F.col("q").alias("_q"))
    marked = df.withColumn("_level", F.coalesce(level.cast("string"), F.lit("<MISSING>")))
    joined = lookup_join(marked, own, ["_level"], "left")
    q = F.coalesce("_q", F.lit(q_global))
    return joined.withColumn(out, set_mask(F.col(probabilities), q, classes)).drop("_level", "_q")


def coverage_summary(df: DataFrame, groups: Sequence[str], mask: str, truth: str, abstain: str | None = None, classes: int = 5) -> DataFrame:
    """Coverage, set sizes and abstention per group; class 0 is the non-event."""
    m, y = F.col(mask), F.col(truth)
    size = F.bit_count(m)
    covered, event = mask_has(m, y), y != 0
    gone = F.col(abstain).cast("boolean") if abstain else size != 1
    wrong = ~F.coalesce(mask_single(m) == y, F.lit(False))
    n = F.count(F.lit(1))
    rate = lambda c: ratio(F.count_if(c), n)
    by = df.groupBy(*groups) if groups else df.groupBy()
    out = by.agg(
        n.alias("n_rows"),
        F.count_if(event).alias("event_count"),
        F.count_if(covered).alias("_covered"),
        F.avg(size).alias("mean_set_size"),
        F.percentile(size, F.lit(0.5)).alias("median_set_size"),
        rate(size == 1).alias("singleton_rate"),
        rate(size == 0).alias("empty_set_rate"),
        rate(size == classes).alias("full_set_rate"),
        rate(gone).alias("abstention_rate"),
        ratio(F.count_if(event & ~gone), F.count_if(~gone)).alias("retained_event_rate"),
        ratio(F.count_if(event & gone), F.count_if(gone)).alias("abstained_event_rate"),
        ratio(F.count_if(wrong & ~gone), F.count_if(~gone)).alias("retained_error_rate"),
        ratio(F.count_if(~covered & gone), F.count_if(gone)).alias("abstained_set_error_rate"),
    )
    lower, upper = wilson(F.col("_covered"), F.col("n_rows"))
    return out.withColumns(
        {
            "coverage": ratio(F.col("_covered"), F.col("n_rows")),
            "coverage_low": lower,
            "coverage_high": upper,
            "event_tier": event_tier(F.col("event_count")),
        }
    ).drop("_covered")


def coverage_by_subgroup(df: DataFrame, keep: Sequence[str], dimensions: Mapping[str, Column], mask: str, truth: str, abstain: str | None = None) -> DataFrame:
    """``coverage_summary`` per (dimension, level); null levels have a label."""
    used = [*keep, mask, truth, *([abstain] if abstain else [])]
    long = subgroups_long(df, used, dimensions)
    return coverage_summary(long, [*keep, "dimension", "level"], mask, truth, abstain)


def named_set_coverage(df: DataFrame, groups: Sequence[str], members: Column, label: Column, names: Mapping[str, str], abstain: Column) -> DataFrame:
    """Coverage of sets given as class names.

    ``names`` maps label names to class names before they are compared; rows
    whose label is outside the map are left out.
    """
    renamed = F.lit(None).cast("string")
    for label_name, class_name in names.items():
        renamed = F.when(label == label_name, class_name).otherwise(renamed)
    known = df.withColumns({"_class": renamed, "_set": members, "_abstain": abstain}).where(F.col("_class").isNotNull())
    n = F.count(F.lit(1))
    by = known.groupBy(*groups) if groups else known.groupBy()
    return by.agg(
        n.alias("n"),
        F.count_if(F.col("_class") != "none").alias("target_events"),
        F.avg(F.array_contains("_set", F.col("_class")).cast("double")).alias("coverage"),
        F.avg(F.size("_set")).alias("mean_set_size"),
        F.avg(F.col("_abstain").cast("double")).alias("abstention_rate"),
    )


def project_cutoffs(cut: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Cutoffs of the named dimensions and the global one, unchanged."""
    return cut.where(F.col("dimension").isin(GLOBAL, *dimensions))
