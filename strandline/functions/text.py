"""Text, code and timestamp columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.layout import MISSING_LABEL, NULL_TOKENS


def strip(c: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_code(c: Column) -> Column:
    """Upper case without outer blanks and dots; a missing code becomes ''."""
    return F.coalesce(F.translate(F.upper(strip(c)), ".", ""), F.lit(""))


def strip_quotes(c: Column) -> Column:
    """Remove outer blanks, then outer single quotes, then outer double quotes."""
    inner = F.regexp_replace(strip(c.cast("string")), r"^'+|'+$", "")
    inner = F.regexp_replace(inner, r'^"+|"+$', "")
    return F.coalesce(strip(inner), F.lit(""))


def normalize_category(c: Column) -> Column:
    """``5.0`` becomes ``5``; other text is only trimmed."""
    return F.coalesce(F.regexp_replace(strip(c.cast("string")), r"^(\d+)\.0$", "$1"), F.lit(""))


def collapse_blanks(c: Column) -> Column:
    """Trim and turn every run of blanks into one space."""
    return F.coalesce(F.regexp_replace(strip(c), r"\s+", " "), F.lit(""))


def place_text(c: Column) -> Column:
    """Upper-case form of ``collapse_blanks``, used for places and types."""
    return F.upper(collapse_blanks(c))


def is_active(status: Column) -> Column:
    """A specification row counts unless its status starts with 'remove'."""
    return ~F.lower(collapse_blanks(status)).startswith("remove")


def decode_nulls(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Read any of the given spellings as null."""
    return F.when(~c.isin(list(tokens)), c)


def to_number(c: Column) -> Column:
    """Text to double; text that is no number becomes null."""
    return c.try_cast("double")


def category_text(c: Column, missing: str = MISSING_LABEL) -> Column:
    """An integer-valued category as text, with a label for missing."""
    return F.coalesce(c.try_cast("long").cast("string"), F.lit(missing))


def parse_timestamp(c: Column) -> Column:
    """ISO text, ``y-m-d h:m:s`` or ``y-m-d``; anything else becomes null."""
    text = strip(c)
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), text.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def is_transfer_place(c: Column) -> Column:
    """The place text names another hospital."""
    text = place_text(c)
    return text.contains("ACUTE HOSPITAL") | (text.contains("TRANSFER") & text.contains("HOSPITAL"))


def starts_with_any(c: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
