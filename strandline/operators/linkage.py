"""Index and follow-up episodes of one entity on integer days.

Nothing here pairs the encounters of an entity with each other.  Encounters
are first reduced to one cell per (entity, day); a calendar year has at most
366 of them, whatever the number of encounters.  Windows run over cells, and
each encounter then looks up the one cell that answers its question.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import to_number
from strandline.functions.values import window_fits_year
from strandline.layout import Encounter
from strandline.operators.skew import crowded, keyed_join, spread_join
from strandline.session import materialise


def range_summary(
    cells: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    axis: str,
    frames: Mapping[str, tuple[int | None, int]],
    aggs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Aggregate, for every query point, the cells within reach of it.

    A frame ``(lo, hi)`` covers cells at ``axis + lo`` .. ``axis + hi``; a
    ``None`` lower end reaches back to the first cell.  ``aggs`` maps an output
    name to a frame and an aggregate over cell columns.  Bounded frames are
    computed inside buckets of the axis as long as the widest frame, so that a
    window partition never spans more than two such lengths; each cell is
    handed to the at most two buckets that can reach it.
    """
    keys = list(keys)
    points = queries.select(*keys, axis).distinct().withColumn("_query", F.lit(True))
    parts = keys
    if all(lo is not None for lo, _ in frames.values()):
        low = min(lo for lo, _ in frames.values())
        length = max(hi for _, hi in frames.values()) - low + 1
        at = lambda c: F.floor(c.cast("double") / F.lit(float(length))).cast("long")
        points = points.withColumn("_bucket", at(F.col(axis) + F.lit(low)))
        near = F.array_distinct(F.array(at(F.col(axis)), at(F.col(axis) - F.lit(length - 1))))
        cells = cells.withColumn("_bucket", F.explode(near))
        parts = [*keys, "_bucket"]
    for c in parts:  # no query looks up a missing key
        cells = cells.where(F.col(c).isNotNull())
    together = points.unionByName(cells.withColumn("_query", F.lit(False)), allowMissingColumns=True)
    base = Window.partitionBy(*parts).orderBy(axis)
    # only parts that hold a query are worth the frames; the order is the same, so rows move and are sorted once
    whole = base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    together = together.withColumn("_asked", F.max("_query").over(whole)).where("_asked")
    spans = {
        name: base.rangeBetween(Window.unboundedPreceding if lo is None else lo, hi)
        for name, (lo, hi) in frames.items()
    }
    found = together.select(
        *keys, axis, "_query", *[agg.over(spans[frame]).alias(out) for out, (frame, agg) in aggs.items()]
    )
    return found.where("_query").drop("_query")


def running(
    df: DataFrame,
    keys: Sequence[str],
    cell: str,
    order: Sequence[str | Column],
    values: Mapping[str, tuple[str, Column]],
    include_current: bool = False,
    backward: bool = False,
) -> DataFrame:
    """Sums, largest or smallest values over all earlier rows of each group, in the order (cell, order).

    ``values`` maps a new column to one of sum, max and min, and an expression.
    ``cell`` cuts the order axis of a group into parts, for instance hours; only
    the totals of whole cells are carried from one part to the next, so a group
    of any size is many short windows.  ``backward`` runs from the last cell to
    the first; ``order`` is then the order inside a cell as it is walked.
    """
    keys = list(keys)
    total = {"sum": F.sum, "max": F.max, "min": F.min}
    none = {"sum": lambda c: F.coalesce(c, F.lit(0)), "max": lambda c: c, "min": lambda c: c}
    both = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
    marked = df.withColumns({f"_{n}": v for n, (_, v) in values.items()})
    cells = marked.groupBy(*keys, cell).agg(*[total[how](f"_{n}").alias(f"_whole_{n}") for n, (how, _) in values.items()])
    along = F.desc(cell) if backward else F.asc(cell)
    earlier = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(
        *keys, cell, *[none[how](total[how](f"_whole_{n}").over(earlier)).alias(f"_carry_{n}") for n, (how, _) in values.items()]
    )
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    found = {n: both[how](F.col(f"_carry_{n}"), none[how](total[how](f"_{n}").over(inside))) for n, (how, _) in values.items()}
    joined = marked.join(carry, [*keys, cell])
    return joined.select(*df.columns, *[c.alias(n) for n, c in found.items()])


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    cell: str,
    order: Sequence[str | Column],
    value: Column,
    out: str,
    include_current: bool = False,
) -> DataFrame:
    """Largest value so far in each group, in the order (cell, order)."""
    return running(df, keys, cell, order, {out: ("max", value)}, include_current)


# cells --------------------------------------------------------------------

def numeric_days(adm: DataFrame, layout: Encounter = Encounter()) -> DataFrame:
    """Day and stay read from text as whole numbers; unreadable text becomes null.

    Must come before any ordering: as text, day 100 sorts before day 90.
    """
    whole = lambda name: F.floor(to_number(F.col(name))).cast("int")
    return adm.withColumns({layout.start: whole(layout.start), layout.stay: whole(layout.stay)})


def day_cells(adm: DataFrame, layout: Encounter = Encounter(), carry: Sequence[str] = ()) -> DataFrame:
    """One row per entity and start day.

    Holds the first unplanned encounter of the day (lowest key) with the
    ``carry`` columns, the counts per planned state, and the highest key.
    """
    start, key, planned = F.col(layout.start), F.col(layout.key), F.col(layout.planned)
    first = F.struct(start.alias("day"), key.alias("key"), F.col(layout.cause).alias("cause"), *carry)
    return (
        adm.where(start.isNotNull())
        .groupBy(*layout.entity, layout.start)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(key).alias("max_key"),
            F.min(F.when(planned == 0, first)).alias("unplanned"),
            F.min(F.when(planned == -1, start)).alias("unknown_day"),
            F.count_if(planned == 1).alias("n_planned"),
            F.count_if(planned == -1).alias("n_unknown"),
        )
    )


def _attach(rows: DataFrame, answers: DataFrame, on: list[str], crowd: bool) -> DataFrame:
    """Left join of rows to their answers, one for each (entity.., day); spread out when an entity is crowded.

    Else the answers of an entity travel as one map by day, so that rows are dealt by
    entity alone and stay where they are for the next look-up.
    """
    if crowd:
        return spread_join(rows, answers, on, "left")
    *who, day = on
    names = [c for c in answers.columns if c not in on]
    told = answers.where(F.col(day).isNotNull() & reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names]))
    along = Window.partitionBy(*who).orderBy(day)
    entries = F.collect_list(F.struct(F.col(day), F.struct(*names))).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = told.select(*who, entries.alias("_entries"), F.row_number().over(along).alias("_place")).where("_place = 1")
    held = held.select(*who, F.map_from_entries("_entries").alias("_answers"))
    joined = keyed_join(rows, held, who, "left").withColumn("_answer", F.col("_answers")[F.col(day)])
    rest = [c for c in rows.columns if c not in on]
    return joined.select(*on, *rest, *[F.col("_answer")[c].alias(c) for c in names])


def with_next_start(
    rows: DataFrame, cells: DataFrame, layout: Encounter = Encounter(), crowd: bool | None = None
) -> DataFrame:
    """Add ``next_start``: start of the next encounter by (day, key).

    Equals ``lead(start)`` over the entity; within a day every row but the one
    with the highest key is followed by a row of the same day.
    """
    on = [*layout.entity, layout.start]
    w = Window.partitionBy(*layout.entity).orderBy(layout.start)
    ahead = cells.select(*on, "max_key", F.lead(layout.start).over(w).alias("next_day"))
    crowd = crowded(cells, list(layout.entity)) if crowd is None else crowd
    joined = _attach(rows, ahead, on, crowd)
    same_day = F.col(layout.key) < F.col("max_key")
    return joined.withColumn(
        "next_start", F.when(same_day, F.col(layout.start)).otherwise(F.col("next_day"))
    ).drop("max_key", "next_day")


def stay_days(layout: Encounter, clip: bool) -> Column:
    stay = F.col(layout.stay)
    return F.greatest(stay, F.lit(0)) if clip else stay


def with_next_gap(
    rows: DataFrame, cells: DataFrame, layout: Encounter = Encounter(), clip: bool = False, crowd: bool | None = None
) -> DataFrame:
    """Add ``next_gap``: days from the end of this stay to the next start."""
    out = with_next_start(rows, cells, layout, crowd)
    return out.withColumn("next_gap", F.col("next_start") - F.col(layout.start) - stay_days(layout, clip))


def with_follow_up(
    rows: DataFrame,
    cells: DataFrame,
    layout: Encounter = Encounter(),
    days: int = 30,
    clip: bool = False,
    crowd: bool | None = None,
) -> DataFrame:
    """Add the summary of encounters that start 1 .. ``days`` days after the stay."""
    end_cols = [*layout.entity, "end_day"]
    rows = rows.withColumn("end_day", F.col(layout.start) + stay_days(layout, clip))
    found = range_summary(
        cells.withColumnRenamed(layout.start, "end_day"),
        rows,
        layout.entity,
        "end_day",
        {"ahead": (1, days)},
        {
            "unplanned": ("ahead", F.min("unplanned")),
            "first_unknown_day": ("ahead", F.min("unknown_day")),
            "planned_follow_ups": ("ahead", F.sum("n_planned")),
            "unknown_follow_ups": ("ahead", F.sum("n_unknown")),
        },
    )
    crowd = crowded(cells, list(layout.entity)) if crowd is None else crowd
    joined = _attach(rows, found, end_cols, crowd)
    return joined.withColumns(
        {
            "first_unplanned_day": F.col("unplanned.day"),
            "follow_up_key": F.col("unplanned.key"),
            "gap_days": F.col("unplanned.day") - F.col("end_day"),
            "planned_follow_ups": F.coalesce("planned_follow_ups", F.lit(0)),
            "unknown_follow_ups": F.coalesce("unknown_follow_ups", F.lit(0)),
        }
    )


# eligibility and outcomes ---------------------------------------------------

def observability(layout: Encounter = Encounter(), days: int = 30) -> dict[str, Column]:
    """Month flags: the last month is out, and the window surely fits the year."""
    month, year = F.col(layout.month), F.col(layout.year)
    return {
        "before_december": month < 12,
        "window_fits_year": window_fits_year(year, month, F.col(layout.stay), days),
    }


def development_rule(
    index_flag: str, age: str, died: str, disposition: str, layout: Encounter = Encounter(), excluded: Sequence[int] = (2, 20)
) -> Column:
    """Index eligibility on typed columns."""
    gap = F.col("next_gap")
    return (
        F.col(index_flag)
        & (F.col(age) >= 18)
        & (F.col(died) == 0)
        & ~F.col(disposition).isin(list(excluded))
        & F.col(layout.start).isNotNull()
        & (F.col(layout.stay) >= 0)
        & F.col(layout.month).between(1, 11)
        & (gap.isNull() | (gap >= 1))
    )


def evaluation_rule(
    index_flag: str, age: str, died: str, disposition: str, layout: Encounter = Encounter(), excluded: Sequence[int] = (2, 20)
) -> Column:
    """Index eligibility on columns that arrive as text; a negative stay counts as 0."""
    number = lambda name: to_number(F.col(name))
    gap = F.col("next_gap")
    return (
        F.col(index_flag)
        & F.col(layout.start).isNotNull()
        & F.col(layout.stay).isNotNull()
        & (number(age) >= 18)
        & (number(died) == 0)
        & ~number(disposition).isin([float(x) for x in excluded])
        & (number(layout.month) <= 11)
        & (gap.isNull() | (gap >= 1))
    )


def outcome_uncertain() -> Column:
    """An unknown encounter comes first, or on the same day as the unplanned one.

    Without any unknown encounter the outcome is certain.  (Replacing missing
    days by infinity would call every negative uncertain, as inf <= inf.)
    """
    unknown, unplanned = F.col("first_unknown_day"), F.col("first_unplanned_day")
    return unknown.isNotNull() & (unplanned.isNull() | (unknown <= unplanned))


def outcome_columns(leaves: int = 4) -> dict[str, Column]:
    """Parent outcome, leaf 0..4 and one indicator per leaf."""
    has = F.col("follow_up_key").isNotNull()
    cause = F.col("unplanned.cause")
    out = {
        "any_follow_up": has,
        "leaf": F.when(has, cause).otherwise(F.lit(0)).cast("int"),
    }
    for leaf in range(1, leaves + 1):
        out[f"leaf_{leaf}"] = F.coalesce(has & (cause == leaf), F.lit(False))
    return out


def build_episodes(
    adm: DataFrame,
    cohort: Column,
    eligible: Column,
    layout: Encounter = Encounter(),
    carry: Sequence[str] = (),
    clip: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Cohort rows with next gap, follow-up summary, outcome and eligibility flags.

    ``cohort`` selects the rows kept; ``eligible`` may refer to ``next_gap``.
    """
    cells = materialise(cells if cells is not None else day_cells(adm, layout, carry), "day_cells")
    crowd = crowded(cells, list(layout.entity))
    rows = with_follow_up(adm.where(cohort), cells, layout, clip=clip, crowd=crowd)
    rows = with_next_gap(rows, cells, layout, clip, crowd)
    rows = rows.withColumns(
        {
            **observability(layout),
            **outcome_columns(),
            "base_eligible": F.coalesce(eligible, F.lit(False)),
            "uncertain": outcome_uncertain(),
            **{f"follow_up_{c}": F.col(f"unplanned.{c}") for c in carry},
        }
    )
    return rows.withColumn("eligible", F.col("base_eligible") & ~F.col("uncertain"))
