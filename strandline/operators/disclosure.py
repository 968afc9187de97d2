"""Suppression of small cells in aggregate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.contracts import DIRECT_IDENTIFIERS, require_no_columns

# Counts that trigger suppression, and other columns of counts.
TRIGGER_COUNTS = ("n_rows", "event_count", "non_events", "missing_n", "valid_n")
OTHER_COUNTS = ("events", "non_event_count", "missing_count", "weighted_event_count", "valid_weight", "weight_sum")

# Numbers that belong to the protocol and stay.
PROTOCOL_NUMBERS = ("n_replicates", "replicates", "seed", "threshold_probability", "nominal_coverage", "nominal")

# Text columns that tell about the size of a cell.
STATUS_COLUMNS = ("event_tier", "status", "calibration_status", "discrimination_status", "coverage_ci95_status")

# Name parts a public table must not have.
RESTRICTED_TOKENS = (
    "patient_hash", "hospital_hash", "patient_id", "subject_id", "encounter_id", "record_id",
    "row_id", "sample_id", "prediction", "probability", "logit", "replicate",
)

SUPPRESSED = "SUPPRESSED_SMALL_CELL"
LIMIT = 10


def is_protocol(name: str) -> bool:
    name = name.lower()
    return name in PROTOCOL_NUMBERS or name.startswith("reference_") or name.endswith("_reference")


def triggers(df: DataFrame) -> dict[str, Column]:
    """Per count column present: is it at most the limit (null is not)."""
    return {c: F.coalesce(F.col(c) <= LIMIT, F.lit(False)) for c in TRIGGER_COUNTS if c in df.columns}


def check_public_columns(df: DataFrame) -> DataFrame:
    kept = df.drop(*[c for c in df.columns if c.lower() in PROTOCOL_NUMBERS])
    require_no_columns(kept, (), RESTRICTED_TOKENS)
    return df


def suppress(df: DataFrame) -> DataFrame:
    """Null every count and estimate of a row with a small count.

    Numbers that are neither keys of the protocol nor reference values are
    taken to depend on the counts, whatever their name.
    """
    fired = triggers(df)
    if not fired:
        return df
    small = _any(fired)

    def rule(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name.lower() in STATUS_COLUMNS:
            return F.when(small, SUPPRESSED).otherwise(c)
        if isinstance(f.dataType, T.NumericType) and not is_protocol(f.name):
            return F.when(~small, c)
        return c

    return df.select(*[rule(f).alias(f.name) for f in df.schema])


def suppression_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key and fired columns of every suppressed row, never a count."""
    fired = triggers(df)
    parts = [
        F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("<MISSING>"))) for k in keys if k in df.columns
    ]
    names = F.array_compact(F.array(*[F.when(hit, F.lit(c)) for c, hit in fired.items()]))
    return df.where(_any(fired)).select(
        F.concat_ws("|", *parts).alias("row_key"), F.array_join(names, ";").alias("trigger_fields"), F.lit(True).alias("suppressed")
    )


def public_count(c: Column) -> tuple[Column, Column]:
    """The count if it may be shown, and whether it was held back."""
    return F.when(c > LIMIT, c), c <= LIMIT


def public_count_text(c: Column) -> Column:
    return F.when(c <= LIMIT, "SUPPRESSED_N_LE_10").otherwise(c.cast("string"))


def unsuppressed_counts(df: DataFrame) -> DataFrame:
    """Rows of (column, value) where a public table shows a count of 1 .. 10."""
    counts = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and _looks_like_count(f.name.lower())
    ]
    if not counts:
        return df.sparkSession.createDataFrame([], "column string, value double")
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in counts]
    return df.select(F.inline(F.array(*entries))).where((F.col("value") > 0) & (F.col("value") <= LIMIT))


def _looks_like_count(name: str) -> bool:
    return name == "n" or any(t in name for t in ("count", "events", "sample_size"))


def leaked_identifiers(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if c.strip().lower() in DIRECT_IDENTIFIERS)


def _any(conditions: dict[str, Column]) -> Column:
    out = F.lit(False)
    for c in conditions.values():
        out = out | c
    return out
