"""Opaque ids, deterministic splits and reproducible draws.

All of them use md5 or sha256, so any engine can repeat them.  A hash prefix
of at most 15 hex digits fits a signed 64-bit integer without a sign bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _material(year: Column, raw: Column) -> Column:
    return F.concat_ws(":", year.cast("string"), F.coalesce(raw.cast("string"), F.lit("")))


def opaque_id(year: Column, raw: Column) -> Column:
    """First 32 hex digits of sha256 over ``year:raw``."""
    return F.substring(F.sha2(_material(year, raw), 256), 1, 32)


def opaque_id_full(year: Column, raw: Column) -> Column:
    """All 64 hex digits of sha256 over ``year:raw``."""
    return F.sha2(_material(year, raw), 256)


def hash_bits(text: Column, digits: int = 15) -> Column:
    """A non-negative bigint from the leading hex digits of md5."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def year_scoped_id(year: Column, raw: Column) -> Column:
    """64-bit id that holds inside one year only."""
    return hash_bits(_material(year, raw))


def half_by_parity(id_: Column, even: str, odd: str) -> Column:
    """Split by the lowest bit of an id."""
    return F.when(F.pmod(id_, F.lit(2)) == 0, even).otherwise(odd)


def nested_half(id_: Column) -> Column:
    """Second lowest bit of an id: 0 to fit, 1 to select."""
    return F.shiftrightunsigned(id_, 1).bitwiseAND(F.lit(1).cast("long")).cast("int")


def draw(parts: list[Column], modulus: Column, digits: int = 12) -> Column:
    """A draw from 0 .. modulus-1 fixed by the given parts."""
    return F.pmod(hash_bits(F.concat_ws(":", *[p.cast("string") for p in parts]), digits), modulus)


def unit_draw(parts: list[Column]) -> Column:
    """A draw from [0, 1) on a grid of 2^-32, fixed by the given parts."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return hash_bits(text, 8).cast("double") / F.lit(float(2**32))
