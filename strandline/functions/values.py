"""Numeric columns: labels, bands, bins, ratios and score transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.layout import OTHER_LABEL, OUT_OF_RANGE_LABEL, Z95


# costs and labels ---------------------------------------------------------

def cost_from_charge(charge: Column, ratio: Column) -> Column:
    """charge x ratio when both are positive, else null."""
    return F.when((charge > 0) & (ratio > 0), charge * ratio)


def at_base_year(cost: Column, year: Column, index: Mapping[int, float], base: float) -> Column:
    """cost x (base index / index of its year); unknown years give null."""
    factor = F.lit(None).cast("double")
    for y, value in index.items():
        factor = F.when(year == y, F.lit(base / value)).otherwise(factor)
    return cost * factor


def label_if_known(value: Column, cutoff: Column | float) -> Column:
    """1 above the cutoff, 0 below, null where the value is not a valid cost."""
    valid = value.isNotNull() & ~F.isnan(value) & (value > 0)
    return F.when(valid, (value > cutoff).cast("int"))


def label_total(condition: Column) -> Column:
    """1 where the condition holds; null counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def window_fits_year(year: Column, month: Column, stay: Column, days: int = 30) -> Column:
    """Even a discharge from a month-end admission leaves ``days`` in the year."""
    month_end = F.dayofyear(F.last_day(F.make_date(year, month, F.lit(1))))
    year_end = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return (month_end + stay + F.lit(days)) <= year_end


def log1p_floor0(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c.cast("double"), F.lit(0.0))))


# bands, bins, tiers -------------------------------------------------------

def age_band(age: Column) -> Column:
    """Closed on the right: (17,44], (44,64], (64,74], above."""
    return (
        F.when((age > 17) & (age <= 44), "18-44")
        .when((age > 44) & (age <= 64), "45-64")
        .when((age > 64) & (age <= 74), "65-74")
        .when(age > 74, "75+")
    )


def age_band_half_open(age: Column) -> Column:
    """Open on the right: below 45, 65, 75; differs for fractional ages."""
    return F.when(age < 45, "18-44").when(age < 65, "45-64").when(age < 75, "65-74").otherwise("75+")


def bin_labels(edges: Sequence[float]) -> list[str]:
    last = len(edges) - 2
    return [
        f"[{lo:g},{hi:g}{']' if i == last else ')'}"
        for i, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ]


def bin_numeric(c: Column, edges: Sequence[float]) -> Column:
    """Half-open bins, the last one closed; everything else has one label."""
    out = F.lit(OUT_OF_RANGE_LABEL)
    labels = bin_labels(edges)
    last = len(labels) - 1
    for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels)):
        inside = (c >= lo) & ((c <= hi) if i == last else (c < hi))
        out = F.when(~F.isnan(c.cast("double")) & inside, label).otherwise(out)
    return out


def bin_category(c: Column, levels: Sequence[str]) -> Column:
    text = c.cast("string")
    return F.when(text.isin(list(levels)), text).otherwise(OTHER_LABEL)


def event_tier(events: Column) -> Column:
    return (
        F.when(events >= 100, "CONFIRMATORY_GE_100_EVENTS")
        .when(events >= 50, "EXPLORATORY_50_TO_99_EVENTS")
        .otherwise("DESCRIPTIVE_LT_50_EVENTS")
    )


def year_slot(year: Column, known: Mapping[int, int], future: int | None = None) -> Column:
    """Index of a known year; other years share a reserved slot only if asked."""
    other = (
        F.lit(future)
        if future is not None
        else F.raise_error(F.concat(F.lit("year outside the contract: "), year.cast("string"))).cast("int")
    )
    out = F.when(year.isNull(), F.raise_error(F.lit("missing year")).cast("int"))
    for y, index in known.items():
        out = out.when(year == y, F.lit(index))
    return out.otherwise(other)


# ratios and intervals -----------------------------------------------------

def ratio(numerator: Column, denominator: Column) -> Column:
    """Null when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Lower and upper 95% bound of a rate; null for an empty group."""
    n = total.cast("double")
    z2 = Z95 * Z95
    p = successes.cast("double") / n
    scale = 1 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / scale
    radius = F.lit(Z95) * F.sqrt((p * (1 - p) + F.lit(z2) / (4 * n)) / n) / scale
    known = total > 0
    return (
        F.when(known, F.greatest(F.lit(0.0), centre - radius)),
        F.when(known, F.least(F.lit(1.0), centre + radius)),
    )


def wilson_effective(rate: Column, weight_sum: Column, weight_sq_sum: Column) -> tuple[Column, Column]:
    """Wilson bounds at the effective size (sum w)^2 / sum w^2, rounded."""
    size = weight_sum * weight_sum / weight_sq_sum
    return wilson(F.bround(rate * size, 0).cast("long"), F.bround(size, 0).cast("long"))


# scores -------------------------------------------------------------------

def clip(p: Column, eps: float = 1e-7) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column, intercept: Column | float, slope: Column | float) -> Column:
    """sigmoid(a + b logit(p))."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return sigmoid(as_col(intercept) + as_col(slope) * logit(p))


# bit masks ----------------------------------------------------------------

def mask_of(flags: Sequence[Column]) -> Column:
    """Booleans in class order to one integer, class 0 in the lowest bit."""
    total = F.lit(0)
    for bit, flag in enumerate(flags):
        total = total + F.when(flag, F.lit(1 << bit)).otherwise(F.lit(0))
    return total.cast("int")


def mask_has(mask: Column, index: Column) -> Column:
    return F.getbit(mask.cast("long"), index.cast("int")) == 1


def mask_single(mask: Column) -> Column:
    """Class index when exactly one bit is set, else null."""
    return F.when(F.bit_count(mask) == 1, F.log2(mask.cast("double")).cast("int"))
