"""Small pieces that several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandline.session import ship

SLICE_ROWS = 256
SLICE_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
_BREAK = re.compile(rb"[\x09-\x0d\x20]")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


Batches = Iterator[pa.RecordBatch]


def in_arrow(rows: DataFrame, work: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """``rows`` through ``work``, a partition at a time, in Arrow batches."""
    ship(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def per_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each key; for groups of a bounded size."""
    ship(rows.sparkSession)
    return rows.groupBy(*keys).applyInArrow(work, schema)


def slices(
    batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that few rows and few bytes of text become Python objects at a time.

    A slice has at most ``rows`` rows and ``size`` bytes, or is one row that is longer.
    """
    for batch in batches:
        widths = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                widths += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(widths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = min(start + rows, int(np.searchsorted(ends, before + size, "right")))
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, or that with underscores before it, so that no column has the name."""
    used = {name.lower() for name in taken}
    while wish.lower() in used:
        wish = f"_{wish}"
    return wish


def word_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """Words between ASCII white space, a bounded piece of a long text at a time."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def fixed_binary(rows) -> pa.Array:
    """A two-dimensional array of bytes as one binary value per row."""
    n, width = rows.shape
    kind = pa.binary(width)
    return pa.FixedSizeBinaryArray.from_buffers(kind, n, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
