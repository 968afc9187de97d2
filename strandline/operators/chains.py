"""Chains of overlapping or transferred stays on timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import is_transfer_place, parse_timestamp
from strandline.layout import Stay
from strandline.operators.history import DAY_US
from strandline.operators.linkage import running, running_max
from strandline.session import materialise


def row_reason(layout: Stay = Stay()) -> Column:
    """Why a row cannot be used; null for a valid one.  The first reason wins."""
    blank = lambda name: F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""
    begin, end = F.col(layout.begin), F.col(layout.end)
    return (
        F.when(blank(layout.entity) | blank(layout.key), "missing_ids")
        .when(begin.isNull() | end.isNull(), "invalid_or_missing_timestamps")
        .when(end < begin, "end_before_begin")
    )


def parse_stays(raw: DataFrame, layout: Stay = Stay()) -> DataFrame:
    """Read both timestamps from text and add ``reason``."""
    parsed = raw.withColumns({c: parse_timestamp(F.col(c)) for c in (layout.begin, layout.end)})
    return parsed.withColumn("reason", row_reason(layout))


def reason_counts(parsed: DataFrame) -> DataFrame:
    """Rows per reason; valid rows and excluded rows add up to the input."""
    return parsed.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


def link_chains(stays: DataFrame, layout: Stay = Stay(), hours: int = 24, cell: str = "hour") -> DataFrame:
    """Add ``chain_id``, the key of the first stay of the chain.

    In the order (begin, end, key) a stay joins the chain before it when it
    begins before the latest end so far, or within ``hours`` of it with a
    transfer place on either side.  Because a new chain begins after every
    earlier end, the latest end of the entity is that of its open chain.
    """
    order = [layout.begin, layout.end, layout.key]
    marked = stays.withColumn("_cell", F.date_trunc(cell, F.col(layout.begin)))
    latest = F.struct(
        F.col(layout.end).alias("end"), F.col(layout.key).alias("key"), F.col(layout.to_place).alias("place")
    )
    seen = running_max(marked, [layout.entity], "_cell", order, latest, "_prev")
    begin, prev = F.unix_micros(layout.begin), F.unix_micros(F.col("_prev.end"))
    near = (begin - prev) <= hours * 3_600_000_000
    moved = is_transfer_place(F.col("_prev.place")) | is_transfer_place(F.col(layout.from_place))
    joins = (begin <= prev) | (near & F.coalesce(moved, F.lit(False)))
    seen = materialise(seen.withColumn("opens", F.col("_prev").isNull() | ~joins).drop("_prev"), "breaks")
    first = F.when(F.col("opens"), F.struct(*order))
    linked = running_max(seen, [layout.entity], "_cell", order, first, "_head", include_current=True)
    return linked.withColumn("chain_id", F.col(f"_head.{layout.key}")).drop("_head", "_cell", "opens")


def chain_table(linked: DataFrame, extra: Sequence[Column] = (), layout: Stay = Stay()) -> DataFrame:
    """One row per chain.  Members stay in the linked table, not in a list."""
    return linked.groupBy(layout.entity, "chain_id").agg(
        F.min(layout.begin).alias(layout.begin),
        F.max(layout.end).alias(layout.end),
        F.count(F.lit(1)).alias("n_stays"),
        *extra,
    )


def principal_code(linked: DataFrame, codes: DataFrame, code: str, rank: str, layout: Stay = Stay()) -> DataFrame:
    """Code with sequence number 1 of the earliest stay of each chain, lowest code at ties."""
    first = codes.where(F.trim(F.col(rank).cast("string")) == "1")
    order = F.struct(layout.begin, layout.end, layout.key, code)
    return (
        linked.join(first, layout.key)
        .groupBy(layout.entity, "chain_id")
        .agg(F.min(order)[code].alias("principal"))
    )


def distinct_events(
    linked: DataFrame,
    events: DataFrame,
    code: Column,
    version: Column,
    rank: Column,
    date_text: Column,
    chain_end: Column | None = None,
    layout: Stay = Stay(),
) -> DataFrame:
    """Distinct (code, version, rank, raw date) per chain.

    With ``chain_end``, events dated after it are dropped; an undated event or
    one with unreadable date text stays, with a null date.
    """
    rows = linked.join(events, layout.key).select(
        layout.entity,
        "chain_id",
        code.alias("code"),
        F.coalesce(version.cast("string"), F.lit("")).alias("version"),
        F.coalesce(rank.cast("string"), F.lit("")).alias("rank"),
        F.coalesce(F.trim(date_text), F.lit("")).alias("raw_date"),
        *([chain_end.alias("_end")] if chain_end is not None else []),
    ).where(F.col("code") != "")
    rows = rows.withColumn("event_ts", parse_timestamp(F.col("raw_date")))
    if chain_end is not None:
        rows = rows.where(F.col("event_ts").isNull() | (F.col("event_ts") <= F.col("_end"))).drop("_end")
    return rows.distinct()


def with_chain_label(
    index: DataFrame, chains: DataFrame, state: str, cause: str, layout: Stay = Stay(), days: int = 30
) -> DataFrame:
    """Follow-up label from chains that begin within ``days`` after the index ended.

    Planned chains are passed over.  An unknown chain before the first
    unplanned one, by (begin, first key), leaves the label open between 0 and 1.
    """
    who = layout.entity
    place = F.struct(F.unix_micros(layout.begin).alias("at"), F.col("chain_id").alias("chain"), F.col(cause).alias("cause"))
    cells = chains.select(
        who,
        F.unix_micros(layout.begin).alias("axis"),
        F.when(F.col(state) == "stable_unplanned", place).alias("_u"),
        F.when(F.col(state) == "algorithm_unknown", place).alias("_x"),
    ).groupBy(who, "axis").agg(F.min("_u").alias("_u"), F.min("_x").alias("_x"))
    rows = index.withColumn("axis", F.unix_micros(layout.end))
    # the first chain after an end is the smallest one behind it, walking from the far end;
    # at equal times the point comes first, so a chain that begins at the end is not seen
    marks = cells.withColumn("_chain", F.lit(1)).unionByName(
        rows.select(who, "axis").distinct().withColumn("_chain", F.lit(0)), allowMissingColumns=True
    ).withColumn("_hour", F.date_trunc("hour", F.timestamp_micros("axis")))
    nearest = {"_unplanned": ("min", F.col("_u")), "_unknown": ("min", F.col("_x"))}
    found = running(marks, [who], "_hour", [F.desc("axis"), "_chain"], nearest, backward=True).where(F.col("_chain") == 0)
    in_reach = lambda c: F.when(c["at"] - F.col("axis") <= days * DAY_US, c)
    found = found.select(who, "axis", *[in_reach(F.col(c)).alias(c) for c in nearest])
    out = rows.join(found, [who, "axis"], "left")
    unplanned, unknown = F.col("_unplanned"), F.col("_unknown")
    first = lambda c: F.struct(c["at"], c["chain"])
    open_ = unknown.isNotNull() & (unplanned.isNull() | (first(unknown) < first(unplanned)))
    known_cause = F.col("_unplanned.cause").isNotNull()
    return out.withColumns(
        {
            "label_status": F.when(open_, "algorithm_unknown")
            .when(unplanned.isNull(), "none")
            .when(known_cause, "qualified")
            .otherwise("cause_unknown"),
            "any_follow_up": F.when(~open_, unplanned.isNotNull().cast("int")),
            "leaf": F.when(~open_, F.when(unplanned.isNull(), "none").otherwise(F.col("_unplanned.cause"))),
            "if_unknown_planned": F.when(open_, 0).otherwise(unplanned.isNotNull().cast("int")),
            "if_unknown_unplanned": F.when(open_, 1).otherwise(unplanned.isNotNull().cast("int")),
        }
    ).drop("axis", "_unplanned", "_unknown")
