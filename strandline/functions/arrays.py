"""Array columns: encoded code lists, procedure timing, model sequences."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.layout import EMPTY_ID, FIRST_CODE_ID, MASK_ID, UNSEEN_ID


def real_ids(ids: Column) -> Column:
    """Ids above the reserved ones; a missing array is an empty one."""
    kept = F.filter(ids, lambda x: x > EMPTY_ID)
    return F.coalesce(kept, F.array().cast("array<int>"))


def count_real(ids: Column) -> Column:
    return F.size(real_ids(ids))


def count_unseen(ids: Column) -> Column:
    return F.coalesce(F.size(F.filter(ids, lambda x: x == UNSEEN_ID)), F.lit(0))


def any_in(codes: Column, wanted: list) -> Column:
    """Any position of the array holds one of the listed codes."""
    if not wanted:
        return F.lit(False)
    return F.coalesce(F.exists(codes, lambda x: x.isin(wanted)), F.lit(False))


def any_prefix(codes: Column, prefixes: list[str] | tuple[str, ...]) -> Column:
    pattern = "^(" + "|".join(prefixes) + ")"
    return F.coalesce(F.exists(codes, lambda x: x.rlike(pattern)), F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often and in whichever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# procedure timing ---------------------------------------------------------

def day_is_missing(day: Column) -> Column:
    """Null, anything from -90 down, and -66 all stand for a missing day."""
    return day.isNull() | (day <= -90) | (day == -66)


def timing_bucket(day: Column, stay: Column) -> Column:
    """0 missing, 1 before, 2 first day, 3 days 1-2, 4 days 3-7, 5 later, 6 after the end."""
    last = F.greatest(F.lit(0), F.coalesce(stay, F.lit(0)))
    return (
        F.when(day_is_missing(day), 0)
        .when(day < 0, 1)
        .when(day > last, 6)
        .when(day == 0, 2)
        .when(day <= 2, 3)
        .when(day <= 7, 4)
        .otherwise(5)
    )


def is_early(day: Column) -> Column:
    return ~day_is_missing(day) & (day <= 0)


def timing_counts(ids: Column, days: Column, stay: Column) -> dict[str, Column]:
    """Six counts over (id, day) pairs, matched by their original position."""
    buckets = F.transform(
        F.filter(F.arrays_zip(ids.alias("id"), days.alias("day")), lambda z: z["id"] > EMPTY_ID),
        lambda z: timing_bucket(z["day"], stay),
    )

    def count(*wanted: int) -> Column:
        return F.coalesce(F.size(F.filter(buckets, lambda b: b.isin(list(wanted)))), F.lit(0))

    return {
        "before_count": count(1),
        "day0_count": count(2),
        "day1_2_count": count(3),
        "day3plus_count": count(4, 5),
        "missing_count": count(0),
        "after_end_count": count(6),
    }


# model sequences ----------------------------------------------------------

def _entry(id_: Column, kind: int, time: Column | int, visit: int, early: Column | bool = False) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        id_.cast("int").alias("id"),
        F.lit(kind).alias("kind"),
        as_col(time).cast("int").alias("time"),
        F.lit(visit).alias("visit"),
        as_col(early).alias("early"),
    )


def _first_ids(ids: Column, shift: int, visit: int, kind: int) -> Column:
    return F.transform(real_ids(ids), lambda x: _entry(x + shift, kind, 0, visit))


def _timed_ids(ids: Column, days: Column, stay: Column, shift: int) -> Column:
    pairs = F.filter(F.arrays_zip(ids.alias("id"), days.alias("day")), lambda z: z["id"] > EMPTY_ID)
    return F.transform(
        F.coalesce(pairs, F.array()),
        lambda z: _entry(z["id"] + shift, 1, timing_bucket(z["day"], stay), 0, is_early(z["day"])),
    )


def _or_empty_token(sequence: Column) -> Column:
    return bound(sequence, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(_entry(F.lit(EMPTY_ID), 0, 0, 0))))


def visit_sequence(
    first: Column,
    second: Column,
    second_days: Column,
    stay: Column,
    prior_first: Column,
    prior_second: Column,
    shift: int,
    limit: int,
) -> Column:
    """Codes of the visit, then the prior bag, cut to ``limit`` entries.

    Ids of the second vocabulary are moved behind the first one.  When there
    is a prior bag, the visit leaves it at least one place.
    """
    if limit < 2:
        raise ValueError("limit must leave room for the visit and the prior bag")
    current = F.concat(_first_ids(first, 0, 0, 0), _timed_ids(second, second_days, stay, shift))
    prior = F.concat(_first_ids(prior_first, 0, 1, 0), _first_ids(prior_second, shift, 1, 1))
    room = F.least(F.size(current), F.lit(limit) - F.when(F.size(prior) > 0, 1).otherwise(0))
    joined = F.concat(F.slice(current, F.lit(1), room), F.slice(prior, F.lit(1), F.lit(limit) - room))
    return _or_empty_token(joined)


def single_visit_sequence(
    first: Column, second: Column, second_days: Column, stay: Column, shift: int, limit: int, first_limit: int = 64
) -> Column:
    """First-vocabulary ids (at most ``first_limit``), then second ones, cut to ``limit``."""
    head = F.slice(_first_ids(first, 0, 0, 0), 1, min(first_limit, limit))
    tail = lambda h: F.slice(_timed_ids(second, second_days, stay, shift), F.lit(1), F.lit(limit) - F.size(h))
    return _or_empty_token(bound(head, lambda h: F.concat(h, tail(h))))


def field(sequence: Column, name: str) -> Column:
    """One member of every entry as an array of its own."""
    return F.transform(sequence, lambda e: e[name])


def masked_sample(key: Column, ids: Column, seed: int, vocabulary_size: int, share: float = 0.15) -> Column:
    """Pick about ``share`` of the real ids, at least one, and corrupt them.

    A picked id becomes the mask id (80%), a random real id (10%) or stays
    (10%).  The choice depends only on the key, the position and the seed, so
    a recomputed task gives the same sample.  Each entry holds the input id
    and, where picked, the original id.

    One md5 is taken per real id, and others only for picked ones; the draws are
    those of ``ids.unit_draw`` and ``ids.draw`` over seed, key, position and use.
    """

    @F.arrow_udf("array<struct<input:int,label:int>>")
    def sample(heads: pa.Array, arrays: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = arrays.flatten().cast(pa.int32())
        ends = np.cumsum(lengths)
        at = np.flatnonzero(pc.fill_null(pc.greater(values, EMPTY_ID), False).to_numpy(zero_copy_only=False))
        row = np.searchsorted(ends, at, side="right")
        pos = at - (ends - lengths)[row]
        texts = [head.encode() for head in heads.to_pylist()]

        def bits(entries: np.ndarray, use: bytes, digits: int) -> list[bytes]:
            pairs = zip(row[entries].tolist(), pos[entries].tolist())
            return [md5(b"%b:%d:%b" % (texts[r], i, use), usedforsecurity=False).digest()[: digits // 2] for r, i in pairs]

        unit = lambda entries, use: np.frombuffer(b"".join(bits(entries, use, 8)), ">u4") / float(2**32)
        u = unit(np.arange(len(at)), b"pick")
        picked = u < share
        # of a row without a pick, the first of its lowest draws
        without = np.flatnonzero(np.bincount(row, picked, len(lengths))[row] == 0)
        order = without[np.lexsort((pos[without], u[without], row[without]))]
        picked[order[np.unique(row[order], return_index=True)[1]]] = True
        chosen = np.flatnonzero(picked)
        how = unit(chosen, b"how")
        swapped = chosen[(how >= 0.8) & (how < 0.9)]
        inputs = values.fill_null(0).to_numpy(zero_copy_only=False).copy()
        inputs[at[chosen[how < 0.8]]] = MASK_ID
        inputs[at[swapped]] = [FIRST_CODE_ID + int.from_bytes(b) % (vocabulary_size - FIRST_CODE_ID) for b in bits(swapped, b"id", 12)]
        unlabelled = np.ones(len(values), bool)
        unlabelled[at[chosen]] = False
        missing = values.is_null().to_numpy(zero_copy_only=False)
        fields = [pa.array(inputs, pa.int32(), mask=missing), pa.array(values.fill_null(0).to_numpy(zero_copy_only=False), pa.int32(), mask=unlabelled)]
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        entries = pa.StructArray.from_arrays(fields, ["input", "label"])
        return pa.ListArray.from_arrays(offsets, entries, mask=arrays.is_null())

    return sample(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")), ids.cast("array<int>"))
