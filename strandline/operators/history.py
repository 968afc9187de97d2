"""Prior-history features of index encounters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.arrays import real_ids
from strandline.layout import Encounter, Stay
from strandline.operators.linkage import range_summary, running
from strandline.operators.skew import crowded, keyed_join, lookup_join, spread_join

DAY_US = 86_400_000_000
BAG_DAYS = 180  # how long the codes of a stay are seen


def _ended(adm: DataFrame, layout: Encounter) -> DataFrame:
    """Stays with the axis on which an index sees them.

    The axis is twice the end day, plus one for a stay of no days: an index
    on day s may count stays that end on s, but a stay without days only when
    it began before s.  Both rules become ``axis <= 2 s``.
    """
    stay = F.greatest(F.coalesce(F.col(layout.stay), F.lit(0)), F.lit(0))
    end = F.col(layout.start) + stay
    return adm.where(F.col(layout.start).isNotNull()).withColumns(
        {"axis": (2 * end + F.when(stay == 0, 1).otherwise(0)).cast("long"), "_end": end, "_stay": stay}
    )


def history_cells(
    adm: DataFrame,
    emergency: str,
    elective: str,
    causes: Sequence[str],
    severities: Sequence[str],
    layout: Encounter = Encounter(),
) -> DataFrame:
    """One row per entity and end of stay."""
    return _ended(adm, layout).groupBy(*layout.entity, "axis").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("_end").alias("last_end"),
        F.count_if(F.coalesce(F.col(emergency), F.lit(0)) > 0).alias("n_emergency"),
        F.count_if(F.coalesce(F.col(elective), F.lit(0)) != 1).alias("n_nonelective"),
        *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"n_{c}") for c in causes],
        F.sum("_stay").alias("stay_sum"),
        *[F.max(s).alias(f"max_{s}") for s in severities],
    )


def seen_stays(adm: DataFrame, index: DataFrame, crowd: DataFrame | None = None, layout: Encounter = Encounter(), days: int = BAG_DAYS) -> DataFrame:
    """Stays that some index of their entity can see; no bag holds a code of the others.

    They end no later than its last index begins and no more than ``days`` before the
    first.  Dropping them before their codes are taken apart changes no bag: a span
    that ends at a stay dropped ends after the last index.  ``crowd`` holds (entity.., n)
    where an entity is crowded.
    """
    who = list(layout.entity)
    bounds = index.groupBy(*who).agg(
        F.min(2 * F.col(layout.start)).alias("_from"), F.max(2 * F.col(layout.start)).alias("_upto")
    )
    stays = _ended(adm, layout)
    met = keyed_join(stays, bounds, who) if crowd is None else spread_join(stays, bounds, who, counts=crowd)
    return met.where(F.col("axis").between(F.col("_from") - 2 * days, F.col("_upto"))).select(*adm.columns)


def id_spans(adm: DataFrame, codes: Sequence[str], layout: Encounter = Encounter(), days: int = BAG_DAYS, dealt: bool = False) -> DataFrame:
    """(entity.., column, id, first, last): where an index sees the id, on the axis of the cells.

    A span begins with a stay and ends ``days`` later, or before the id's next
    stay; the spans of one id never overlap, so an index meets each id once.
    ``dealt`` says that the rows lie by entity already, and none is crowded: then
    they are not moved again.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), real_ids(F.col(c)).alias("ids")) for c in codes])
    each = _ended(adm, layout).select(*layout.entity, "axis", F.inline(entries))
    seen = each.select(*layout.entity, "axis", "column", F.explode("ids").alias("id"))
    # dealt by the keys of the window, so that finding distinct rows moves them no second time
    seen = (seen if dealt else seen.repartition(*layout.entity, "column", "id")).distinct()
    following = Window.partitionBy(*layout.entity, "column", "id").orderBy("axis")
    return seen.select(
        *layout.entity, "column", "id", F.col("axis").alias("first"),
        F.least(F.lead("axis").over(following) - 1, F.col("axis") + 2 * days).alias("last"),
    )


def id_bags(index: DataFrame, spans: DataFrame, codes: Sequence[str], layout: Encounter = Encounter(), days: int = BAG_DAYS) -> DataFrame:
    """Sorted ids that each (entity, axis) of ``index`` sees, a column ``bag_<c>`` for each of ``codes``."""
    keys, width = [*layout.entity, "axis"], 2 * days + 1
    part = lambda c: F.floor(F.col(c) / width)
    # a span touches two parts of the axis at most
    cut = spans.withColumn("_part", F.explode(F.sequence(part("first"), part("last"))))
    rows = index.select(*keys, part("axis").alias("_part")).distinct()
    met = keyed_join(rows, cut, [*layout.entity, "_part"]).where("axis BETWEEN first AND last")
    ids = lambda c: F.array_sort(F.collect_list(F.when(F.col("column") == c, F.col("id"))))
    return met.groupBy(*keys).agg(*[ids(c).alias(f"bag_{c}") for c in codes])


def with_history(
    index: DataFrame,
    cells: DataFrame,
    spans: DataFrame,
    causes: Sequence[str],
    severities: Sequence[str],
    codes: Sequence[str],
    layout: Encounter = Encounter(),
    crowd: bool | None = None,
) -> DataFrame:
    """Add counts, sums and maxima of the stays before each index, and the ids of their codes."""
    keys = [*layout.entity, "axis"]
    rows = index.withColumn("axis", (2 * F.col(layout.start)).cast("long"))
    frames = {"ytd": (None, 0), "30d": (-60, 0), "90d": (-180, 0), "180d": (-360, 0)}
    zero = lambda c: F.coalesce(c, F.lit(0))
    aggs = {"prior_count_ytd": ("ytd", F.sum("n")), "_last_end": ("ytd", F.max("last_end"))}
    aggs |= {f"prior_count_{d}": (d, F.sum("n")) for d in ("30d", "90d", "180d")}
    aggs |= {
        "prior_emergency_180d": ("180d", F.sum("n_emergency")),
        "prior_nonelective_180d": ("180d", F.sum("n_nonelective")),
        "prior_stay_sum_180d": ("180d", F.sum("stay_sum")),
    }
    aggs |= {f"prior_{c}_180d": ("180d", F.sum(f"n_{c}")) for c in causes}
    aggs |= {f"prior_max_{s}_180d": ("180d", F.max(f"max_{s}")) for s in severities}
    numbers = [name for name in aggs if name != "_last_end"]
    found = range_summary(cells, rows, layout.entity, "axis", frames, aggs)
    found = keyed_join(found, id_bags(rows, spans, codes, layout), keys, "left")
    hot = crowded(cells, list(layout.entity)) if crowd is None else crowd
    joined = spread_join(rows, found, keys, "left") if hot else keyed_join(rows, found, keys, "left")
    month = F.col(layout.month)
    return joined.withColumns(
        {
            **{name: zero(F.col(name)) for name in numbers},
            **{f"prior_{c}_180d": F.coalesce(f"bag_{c}", F.array().cast("array<int>")) for c in codes},
            "days_since_prior": F.coalesce(F.col(layout.start) - F.col("_last_end"), F.lit(-1)),
            "seen_30d": month >= 2,
            "seen_90d": month >= 4,
            "seen_180d": month >= 7,
        }
    ).drop("axis", "_last_end", *[f"bag_{c}" for c in codes])


def with_stay_history(
    index: DataFrame,
    chains: DataFrame,
    sums: Sequence[str] = (),
    layout: Stay = Stay(),
    chain: str = "chain_id",
) -> DataFrame:
    """History of timestamp chains: those that ended strictly before the index began.

    ``sums`` are numeric chain columns added up over the last 180 days.
    """
    who = layout.entity
    begin, end = F.unix_micros(layout.begin), F.unix_micros(layout.end)
    measures = ["n", "stay_us", *sums]
    cells = chains.select(who, end.alias("axis"), (end - begin).alias("stay_us"), *sums).groupBy(who, "axis").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures[1:]]
    )
    rows = index.withColumn("axis", begin)
    # a frame is the difference of two running totals: at the begin, and where the frame starts
    year = F.unix_micros(F.date_trunc("year", F.timestamp_micros("axis")))
    starts = {"now": F.col("axis"), "ytd": year, **{d: F.col("axis") - int(d[:-1]) * DAY_US for d in ("30d", "90d", "180d")}}
    probes = rows.select(who, "axis").distinct().select(
        who,
        F.col("axis").alias("_at"),
        F.inline(F.array(*[F.struct(F.lit(name).alias("_name"), at.alias("axis")) for name, at in starts.items()])),
    )
    marks = cells.withColumn("_end", F.lit(1)).unionByName(probes.withColumn("_end", F.lit(0)), allowMissingColumns=True)
    marks = marks.withColumn("_hour", F.date_trunc("hour", F.timestamp_micros("axis")))
    # at equal times the probe comes first, so an end at its time is not seen
    before = {f"_before_{m}": ("sum", F.coalesce(F.col(m), F.lit(0))) for m in measures}
    before["_last"] = ("max", F.when(F.col("_end") == 1, F.col("axis")))
    seen = running(marks, [who], "_hour", ["axis", "_end"], before).where(F.col("_end") == 0)
    at = lambda name, m: F.max(F.when(F.col("_name") == name, F.col(m)))
    frames = [("30d", "n"), ("90d", "n"), ("180d", "n"), ("ytd", "n"), ("180d", "stay_us"), *[("180d", m) for m in sums]]
    found = seen.groupBy(who, F.col("_at").alias("axis")).agg(
        at("now", "_last").alias("_last"),
        *[(at("now", f"_before_{m}") - at(d, f"_before_{m}")).alias(f"_{m}_{d}") for d, m in frames],
    )
    first_seen = chains.groupBy(who).agg(F.min(begin).alias("_first"))
    out = lookup_join(rows.join(found, [who, "axis"], "left"), first_seen, [who], "left")
    return out.withColumns(
        {
            **{f"prior_count_{d}": F.coalesce(f"_n_{d}", F.lit(0)) for d in ("30d", "90d", "180d", "ytd")},
            **{f"prior_{m}_180d": F.coalesce(f"_{m}_180d", F.lit(0)) for m in sums},
            "prior_stay_days_180d": F.coalesce("_stay_us_180d", F.lit(0)) / DAY_US,
            "days_since_prior": (F.col("axis") - F.col("_last")) / DAY_US,
            **{
                f"seen_{d}": (F.col("axis") - F.col("_first") >= int(d[:-1]) * DAY_US).cast("int")
                for d in ("30d", "90d", "180d")
            },
        }
    ).drop("axis", "_last", "_first", *[f"_{m}_{d}" for d, m in frames])
