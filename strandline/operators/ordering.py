"""Exact order-based results without sorting a whole table in one task.

Running totals, ranks and order statistics all follow one plan: rows are
first collapsed to one row per distinct value, the value axis is cut into
ranges, totals of whole ranges are summed up over a small table, and only the
order inside a range is left to a window.  A value shared by a third of all
rows is one row of the collapsed table; where rows inside such a tie must be
told apart, the tie is cut again along a second column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.contracts import required
from strandline.operators.skew import crowded, lookup_join
from strandline.session import materialise

RANGE_ROWS = 200_000
MAX_RANGES = 4096
CROWDED_RANGES = 4  # times the rows of a range, at which a part is cut again
SKETCH_CUTS = 1_000  # places that a sketch gives
SKETCH_SLACK = 2  # cuts by which a bracket is wider on each side
SKETCH_ACCURACY = 10_000
SKETCHED_GROUPS = 10_000
SAMPLE_VALUES = 32  # per range, for edges of types that are not numbers


def range_edges(df: DataFrame, value: str, rows: int = RANGE_ROWS) -> list[str]:
    """Inner edges, as text, that cut ``value`` into ranges of about ``rows`` rows.

    Numbers are cut at approximate quantiles, other types at quantiles of a
    sample of distinct values drawn by hash.  Infinite edges are left out.
    """
    ranges = min(MAX_RANGES, -(-df.count() // rows))
    if ranges <= 1:
        return []
    kind = df.schema[value].dataType
    if isinstance(kind, T.NumericType):
        shares = [i / ranges for i in range(1, ranges)]
        found = df.select(F.col(value).cast("double").alias("v")).approxQuantile("v", shares, 0.25 / ranges)
        whole = isinstance(kind, T.IntegralType)
        return [str(math.ceil(e)) if whole else repr(e) for e in sorted(set(found)) if math.isfinite(e)]
    sample = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct()
    sample = sample.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_VALUES * ranges)
    found = [r["t"] for r in sample.orderBy("v").select(F.col("v").cast("string").alias("t")).collect()]
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if len(found) >= ranges else found[1:]


def with_range(df: DataFrame, value: str, edges: Sequence[str | float], out: str = "_range") -> DataFrame:
    """Number of the range each value falls into; ranges follow the value order.

    Values are compared with the edges in their own type, by halving.
    """
    kind = df.schema[value].dataType.simpleString()
    name = value.replace("`", "``")
    texts = [repr(e) if isinstance(e, float) else str(e) for e in edges]
    texts = [t.replace("\\", "\\\\").replace("'", "\\'") for t in texts]

    def pick(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"IF(`{name}` < CAST('{texts[middle]}' AS {kind}), {pick(low, middle)}, {pick(middle + 1, high)})"

    return df.withColumn(out, F.expr(pick(0, len(texts))))


def _before(df: DataFrame, groups: list[str], order: list[str], measures: list[str]) -> DataFrame:
    """Totals of all earlier rows of the group, per measure ``_before_<m>``."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        "*", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"_before_{m}") for m in measures]
    )


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    measures: Sequence[str],
    rows: int = RANGE_ROWS,
    edges: Sequence[str | float] | None = None,
) -> DataFrame:
    """Add ``cum_<m>``: the total of a measure up to and with each value.

    ``df`` holds one row per (group, value).  ``edges`` may hand in ranges that
    are known already.
    """
    groups, measures = list(groups), list(measures)
    edges = range_edges(df, value, rows) if edges is None else list(edges)
    cut = with_range(df, value, edges)
    inside = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(m).over(inside).alias(f"_in_{m}") for m in measures])
    if not edges:
        cums = [F.col(f"_in_{m}").alias(f"cum_{m}") for m in measures]
        return local.select(*df.columns, *cums)
    totals = cut.groupBy(*groups, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = _before(totals, groups, ["_range"], measures).drop(*measures)
    joined = local.join(offsets, [*groups, "_range"])
    cums = [(F.col(f"_before_{m}") + F.col(f"_in_{m}")).alias(f"cum_{m}") for m in measures]
    return joined.select(*df.columns, *cums)


def running_rows(
    df: DataFrame,
    groups: Sequence[str],
    lead: Sequence[str],
    tie: str,
    measures: Sequence[str],
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Row-level ``cum_<m>`` in the order (lead columns, tie).

    ``lead`` columns are ascending, and ``tie`` settles the order of equal
    leads; both may have any type that has an order.  Rows are moved once: by
    group where no group is crowded, by (group, range of the first lead) where no
    value of it is, and else by (group, lead, range of tie).
    """
    groups, lead, measures = list(groups), list(lead), list(measures)
    df = required(df, *groups, *lead, tie)
    if groups and not crowded(df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")), groups, CROWDED_RANGES * rows):
        return _in_parts(df, groups, lead, tie, measures)
    edges = range_edges(df, lead[0], rows)
    if edges:
        cut = with_range(df, lead[0], edges)
        totals = cut.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(m).alias(m) for m in measures])
        totals = materialise(totals, "ranges")
        if totals.where(F.col("_rows") > CROWDED_RANGES * rows).isEmpty():
            offsets = materialise(_before(totals, groups, ["_range"], measures).drop("_rows", *measures), "offsets")
            local = _in_parts(cut, [*groups, "_range"], lead, tie, measures)
            cums = [(F.col(f"_before_{m}") + F.col(f"cum_{m}")).alias(f"cum_{m}") for m in measures]
            return lookup_join(local, offsets, [*groups, "_range"], "inner").select(*df.columns, *cums)
    tie_edges = range_edges(df, tie, rows)
    if not tie_edges:  # no more than ``rows`` rows altogether
        return _in_parts(df, groups, lead, tie, measures)
    cut = with_range(df, tie, tie_edges, "_tie_range")
    cells = materialise(cut.groupBy(*groups, *lead, "_tie_range").agg(*[F.sum(m).alias(m) for m in measures]), "cells")
    per_lead = cells.groupBy(*groups, *lead).agg(*[F.sum(m).alias(m) for m in measures])
    lead_edges = range_edges(per_lead, lead[0], rows)
    per_lead = with_range(per_lead, lead[0], lead_edges)
    ranges = per_lead.groupBy(*groups, "_range").agg(*[F.sum(m).alias(m) for m in measures])
    range_offsets = _before(ranges, groups, ["_range"], measures).select(
        *groups, "_range", *[F.col(f"_before_{m}").alias(f"_r_{m}") for m in measures]
    )
    lead_offsets = (
        _before(per_lead, [*groups, "_range"], lead, measures)
        .join(range_offsets, [*groups, "_range"])
        .select(*groups, *lead, *[(F.col(f"_before_{m}") + F.col(f"_r_{m}")).alias(f"_l_{m}") for m in measures])
    )
    cell_offsets = (
        _before(cells, [*groups, *lead], ["_tie_range"], measures)
        .join(lead_offsets, [*groups, *lead])
        .select(
            *groups,
            *lead,
            "_tie_range",
            *[(F.col(f"_before_{m}") + F.col(f"_l_{m}")).alias(f"_c_{m}") for m in measures],
        )
    )
    keys = [*groups, *lead, "_tie_range"]
    inside = Window.partitionBy(*keys).orderBy(tie).rowsBetween(Window.unboundedPreceding, 0)
    joined = lookup_join(cut, materialise(cell_offsets, "offsets"), keys, "inner")
    cums = [(F.col(f"_c_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures]
    return joined.select(*df.columns, *cums)


def _in_parts(df: DataFrame, parts: list[str], lead: list[str], tie: str, measures: list[str]) -> DataFrame:
    """``cum_<m>`` inside each part, none of which is long."""
    w = Window.partitionBy(*parts).orderBy(*lead, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.sum(m).over(w).alias(f"cum_{m}") for m in measures])


def order_number(df: DataFrame, groups: Sequence[str], lead: Sequence[str], tie: str, out: str = "order_no") -> DataFrame:
    """Position of each row in its group by (lead, tie), starting at 1."""
    numbered = running_rows(df.withColumn("_one", F.lit(1).cast("long")), groups, lead, tie, ["_one"])
    return numbered.withColumnRenamed("cum__one", out).drop("_one")


def dense_index(
    df: DataFrame, groups: Sequence[str], cell: Sequence[str], order: Sequence[str], out: str = "index"
) -> DataFrame:
    """0-based position by (cell, order) inside each group.

    ``cell`` columns come first in the wanted order and cut a group into parts,
    for instance the leading digits of a hash.
    """
    groups, cell, order = list(groups), list(cell), list(order)
    keys = [*groups, *cell]
    df = required(df, *keys, *order)
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*groups).orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.join(offsets, keys)
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_offset")
    )


# order statistics and quantiles -------------------------------------------

def value_counts(df: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per (group, value): ``n`` rows and their weight ``w``."""
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    return required(df, *groups, value).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"), w.alias("w"))


def _ranked(df: DataFrame, groups: list[str], value: str, weight: str | None, rows: int) -> DataFrame:
    counts = materialise(value_counts(df, groups, value, weight), "counts")
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total_n"), F.sum("w").alias("total_w"))
    return lookup_join(running_totals(counts, groups, value, ["n", "w"], rows), totals, groups, "inner")


def _single(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    groups = list(groups)
    return (df, groups) if groups else (df.withColumn("_all", F.lit(0)), ["_all"])


def order_statistics(df: DataFrame, groups: Sequence[str], value: str, ranks: Mapping[str, Callable], rows: int = RANGE_ROWS) -> DataFrame:
    """Values with given ranks (1-based) in each group, one column per entry.

    Each entry of ``ranks`` maps the column holding the group size to a rank; a rank
    that no row has gives null.  For numbers, sketches that merge bracket each rank; a second pass
    counts what is below a bracket and ranks only what is inside, so only that is
    shuffled.  A rank that its bracket misses, or a table of more than
    ``SKETCHED_GROUPS`` groups, is ranked from all distinct values; the values are the same.
    """
    df, keys = _single(df, groups)
    df = required(df, *keys, value).select(*keys, value)
    if not isinstance(df.schema[value].dataType, T.NumericType):
        return _from_all_values(df, keys, value, ranks, rows).select(*groups, "n", *ranks)
    shares = [i / SKETCH_CUTS for i in range(SKETCH_CUTS + 1)]
    sketch = F.percentile_approx(value, shares, SKETCH_ACCURACY).alias("_cuts")
    sizes = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch), "sketch")
    if sizes.count() > SKETCHED_GROUPS:
        return _from_all_values(df, keys, value, ranks, rows).select(*groups, "n", *ranks)
    place = F.col("_k") - 1
    position = place * SKETCH_CUTS / F.greatest(F.col("n") - 1, F.lit(1))
    wanted = sizes.select(
        *keys, "n", "_cuts", F.inline(F.array(*[F.struct(F.lit(name).alias("_entry"), rank(F.col("n")).cast("long").alias("_k")) for name, rank in ranks.items()]))
    ).where(F.col("_k").between(1, F.col("n")))
    # a place outside the cuts is null: no bound on that side
    bounds = F.struct(
        "_entry", "_k",
        F.get("_cuts", (F.floor(position) - SKETCH_SLACK).cast("int")).alias("lo"),
        F.get("_cuts", (F.ceil(position) + SKETCH_SLACK).cast("int")).alias("hi"),
    )
    plan = wanted.groupBy(*keys).agg(F.collect_list(bounds).alias("_brackets"))
    v = F.col(value)
    hits = F.filter("_brackets", lambda b: b["hi"].isNull() | (v <= b["hi"]))
    # all that is below a bracket becomes one null value, counted before the shuffle
    inside = F.transform(hits, lambda b: F.struct(b["_entry"].alias("_entry"), b["_k"].alias("_k"), F.when(b["lo"].isNull() | (v >= b["lo"]), v).alias("_v")))
    near = lookup_join(df, plan, keys, "inner").select(*keys, F.inline(inside))
    counts = materialise(near.groupBy(*keys, "_entry", "_k", "_v").agg(F.count(F.lit(1)).cast("double").alias("n")), "bracket")
    below = counts.where("_v IS NULL").select(*keys, "_entry", F.col("n").alias("_below"))
    totals = running_totals(counts.where("_v IS NOT NULL"), [*keys, "_entry"], "_v", ["n"], rows)
    upto = F.col("cum_n") + F.coalesce("_below", F.lit(0.0))
    ranked = totals.join(below, [*keys, "_entry"], "left").where((upto >= F.col("_k")) & (upto - F.col("n") < F.col("_k")))
    found = materialise(ranked.select(*keys, "_entry", F.col("_v").alias(value)), "ranked")
    missed = wanted.join(found, [*keys, "_entry"], "left_anti").select(*keys).distinct()
    columns = [F.max(F.when(F.col("_entry") == name, F.col(value))).alias(name) for name in ranks]
    out = sizes.select(*keys, "n").join(found.groupBy(*keys).agg(*columns), keys, "left")
    if not missed.isEmpty():
        exact = _from_all_values(lookup_join(df, missed, keys, "left_semi"), keys, value, ranks, rows)
        out = out.join(missed, keys, "left_anti").unionByName(exact)
    return out.select(*groups, "n", *ranks)


def _from_all_values(df: DataFrame, keys: list[str], value: str, ranks: Mapping[str, Callable], rows: int) -> DataFrame:
    ranked = _ranked(df, keys, value, None, rows)
    size, cum, n = F.col("total_n"), F.col("cum_n"), F.col("n")
    at = lambda k: F.max(F.when((cum >= k) & (cum - n < k), F.col(value)))
    found = ranked.groupBy(*keys).agg(F.max(size).alias("_size"), *[at(rank(size)).alias(name) for name, rank in ranks.items()])
    return found.select(*keys, F.col("_size").alias("n"), *ranks)


def order_statistic(df: DataFrame, groups: Sequence[str], value: str, rank: Callable, out: str = "value", rows: int = RANGE_ROWS) -> DataFrame:
    """The value with the given rank in each group, with the group size."""
    return order_statistics(df, groups, value, {out: rank}, rows)


def upper_quantile(df: DataFrame, groups: Sequence[str], value: str, q: float, out: str = "value", rows: int = RANGE_ROWS) -> DataFrame:
    """The smallest value at or above position (n-1) q."""
    return order_statistic(df, groups, value, lambda n: F.ceil((n - 1) * F.lit(q)) + 1, out, rows)


def linear_quantile(df: DataFrame, groups: Sequence[str], value: str, q: float, out: str = "value", rows: int = RANGE_ROWS) -> DataFrame:
    """Linear interpolation at position (n-1) q."""
    place = lambda n: (n - 1) * F.lit(float(q))
    around = {"_lo": lambda n: F.floor(place(n)) + 1, "_hi": lambda n: F.ceil(place(n)) + 1}
    found = order_statistics(df, groups, value, around, rows)
    lo, hi, part = F.col("_lo").cast("double"), F.col("_hi").cast("double"), place(F.col("n")) - F.floor(place(F.col("n")))
    return found.select(*groups, "n", (lo + (hi - lo) * part).alias(out))


def weighted_step_quantile(df: DataFrame, groups: Sequence[str], value: str, weight: str, q: float, out: str = "value", rows: int = RANGE_ROWS) -> DataFrame:
    """First value whose cumulative weight reaches q of the total weight.

    Rows without a finite value or a positive weight are left out.
    """
    v, w = F.col(value).cast("double"), F.col(weight).cast("double")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    valid, keys = _single(df.where(finite(v) & finite(w) & (w > 0)), groups)
    ranked = _ranked(valid, keys, value, weight, rows)
    reached = F.when(F.col("cum_w") >= F.lit(float(q)) * F.col("total_w"), F.col(value).cast("double"))
    found = ranked.groupBy(*keys).agg(
        F.coalesce(F.min(reached), F.max(F.col(value).cast("double"))).alias(out),
        F.max("total_n").alias("n"),
        F.max("total_w").alias("weight_sum"),
    )
    return found.select(*groups, "n", "weight_sum", out)


def midpoint_points(df: DataFrame, groups: Sequence[str], value: str, weight: str, tie: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Positions on the weight axis of the first and the last row of each value.

    A row sits at (weight before it + half its own weight) / total.  Rows of
    one value are ordered by ``tie``; only the outer two matter for
    interpolation, so the collapsed table carries just those.
    """
    df, keys = _single(required(df, *groups, value, weight, tie), groups)
    collapsed = df.groupBy(*keys, value).agg(
        F.sum(weight).alias("w"),
        F.min_by(weight, tie).alias("_first"),
        F.max_by(weight, tie).alias("_last"),
    )
    collapsed = materialise(collapsed, "points")
    totals = collapsed.groupBy(*keys).agg(F.sum("w").alias("_total"))
    cum = lookup_join(running_totals(collapsed, keys, value, ["w"], rows), totals, keys, "inner")
    return cum.select(
        *keys,
        F.col(value).cast("double").alias("x"),
        ((F.col("cum_w") - F.col("w") + F.col("_first") / 2) / F.col("_total")).alias("lo"),
        ((F.col("cum_w") - F.col("_last") / 2) / F.col("_total")).alias("hi"),
    )


def midpoint_quantiles(df: DataFrame, groups: Sequence[str], value: str, weight: str, tie: str, qs: Sequence[float], out: str = "values", rows: int = RANGE_ROWS) -> DataFrame:
    """Weighted quantiles by linear interpolation between weight midpoints.

    Returns one array per group, in the order of ``qs``; outside the first and
    last midpoint the end value holds.
    """
    points = midpoint_points(df, groups, value, weight, tie, rows)
    keys = list(groups) or ["_all"]
    aggs = []
    for i, q in enumerate(qs):
        q = float(q)
        low = F.when(F.col("hi") <= q, F.struct("hi", "x")).when(F.col("lo") <= q, F.struct(F.lit(q).alias("hi"), F.col("x")))
        high = F.when(F.col("lo") >= q, F.struct("lo", "x")).when(F.col("hi") >= q, F.struct(F.lit(q).alias("lo"), F.col("x")))
        aggs += [F.max(low).alias(f"_low{i}"), F.min(high).alias(f"_high{i}")]
    picked = points.groupBy(*keys).agg(*aggs)

    def at(i: int, q: float):
        a, b = F.col(f"_low{i}"), F.col(f"_high{i}")
        gap = b["lo"] - a["hi"]
        between = a["x"] + (b["x"] - a["x"]) * F.when(gap > 0, (F.lit(q) - a["hi"]) / gap).otherwise(F.lit(0.0))
        return F.when(a.isNull(), b["x"]).when(b.isNull(), a["x"]).otherwise(between)

    return picked.select(*groups, F.array(*[at(i, float(q)) for i, q in enumerate(qs)]).alias(out))


# capacity -----------------------------------------------------------------

def capacity_flags(df: DataFrame, score: str, key: str, share: float, out: str = "flagged", rows: int = RANGE_ROWS) -> tuple[DataFrame, dict]:
    """Flag exactly ceil(share * n) rows by score descending, key ascending.

    Works with two cut values instead of a global sort: the score at the
    boundary, and the largest key still taken among rows at that score.
    Returns the flagged table and a report on the boundary.  Scores that are
    missing or not finite are an error, and so are keys that are missing or
    repeat among the rows at the boundary, as no exact number could be taken.
    """
    pairs = materialise(df.select(F.col(score).cast("double").alias("s"), F.col(key).alias("k")), "capacity")
    counts = materialise(pairs.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "scores")
    unsound = F.col("s").isNull() | F.isnan("s") | (F.abs("s") == float("inf"))
    facts = counts.agg(F.sum("n").alias("total"), F.count_if(unsound).alias("unsound")).first()
    total = facts["total"] or 0
    if facts["unsound"]:
        raise ValueError("capacity needs finite scores")
    if not total or not 0 < share <= 1:
        raise ValueError("capacity needs rows and a share in (0, 1]")
    wanted = math.ceil(share * total)
    down = counts.select("s", (-F.col("s")).alias("_neg"), "n")
    ranked = running_totals(down, [], "_neg", ["n"], rows)
    hit = ranked.where((F.col("cum_n") >= wanted) & (F.col("cum_n") - F.col("n") < wanted)).first()
    boundary, ties, above = hit["s"], hit["n"], hit["cum_n"] - hit["n"]
    need = wanted - above
    last_key = None
    if need < ties:
        tied = pairs.where(F.col("s") == F.lit(boundary))
        repeated = tied.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("k").isNull())
        if not repeated.isEmpty():
            raise ValueError("keys at the boundary are missing or repeat")
        last_key = order_statistic(tied, [], "k", lambda n: F.lit(need), rows=rows).first()["value"]
    value = F.col(score).cast("double")
    at_cut = value == F.lit(boundary)
    taken = at_cut if last_key is None else at_cut & (F.col(key) <= F.lit(last_key))
    flagged = df.withColumn(out, (value > F.lit(boundary)) | taken)
    report = {
        "capacity_rows": wanted,
        "boundary_score": boundary,
        "boundary_ties": ties,
        "boundary_ties_taken": need,
    }
    return flagged, report
