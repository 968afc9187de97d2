"""Writers: compressed tables, small reports, and publishing exactly once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import file_system


class AlreadyPublished(RuntimeError):
    """A finished or unfinished output is already there."""


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), block_bytes: int = 128 * 1024 * 1024) -> None:
    """Parquet with zstd; never over an existing table.

    With partition columns, rows are brought together by their values first, so
    that few files are written; the rebalance hint lets Spark cut a partition
    value with many rows into several tasks.
    """
    rows = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by else df
    writer = rows.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", block_bytes)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, order: Sequence[str], fmt: str = "csv", one_file: bool = False) -> None:
    """A table as sorted text files; ``one_file`` is for a caller who knows that it is short."""
    columns = sorted(df.columns) if fmt == "json" else df.columns
    ordered = df.select(*columns).orderBy(*order)
    ordered = ordered.coalesce(1) if one_file else ordered
    writer = ordered.write.mode("errorifexists")
    writer.json(path) if fmt == "json" else writer.csv(path, header=True)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write a table once; it counts from the moment its marker ``<path>.published`` exists.

    Creating ``<path>.claim`` is one step that only one writer can take, so two
    writers cannot both pass.  Refuses when a finished output, the claim of
    another writer or the remains of an unfinished output exist.
    """
    final, fs = file_system(spark, path)
    claim, _ = file_system(spark, path + ".claim")
    marker, _ = file_system(spark, path + ".published")
    if fs.exists(final) or fs.exists(marker):
        raise AlreadyPublished(path)
    try:
        fs.create(claim, False).close()
    except Exception as error:
        raise AlreadyPublished(path) from error
    write(path)
    fs.create(marker, False).close()
    return path


def write_artifacts(root: str, source: DataFrame, artifacts: Mapping[str, Callable[[DataFrame], DataFrame]]) -> dict[str, str]:
    """Several tables from one source; the source should be materialised."""
    out = {}
    for name, make in artifacts.items():
        out[name] = f"{root}/{name}"
        write_table(make(source), out[name])
    return out
