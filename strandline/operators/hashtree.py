"""Two versions of a table compared by a hash tree, before any row is read.

A version is published as its rows, dealt to folders and sorted by key range, and
a tree of fingerprints: for every range of keys the number of its rows, the sum and
the exclusive-or of their hashes, and the same for every group of ``FAN`` nodes
below.  Row order and file layout have no part in them.  Two versions are compared
from the root: only children of nodes that differ are looked at, and only the rows
of the ranges that differ are read, by folder and by row group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.contracts import required

FAN_BITS = 4  # children of a node: 16
RANGE_BITS = 12  # ranges of a version: 4,096
FOLDER_BITS = 6  # folders the ranges lie in: 64
TREE = "node int, n long, total decimal(38,0), mixed long, level int"


def hashed_range(key: Column, bits: int = RANGE_BITS) -> Column:
    """Range of a key by its hash, for keys of any type."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int")


def even_range(key: Column, low: int, high: int, bits: int = RANGE_BITS) -> Column:
    """Range of a whole number among even parts of ``low`` to ``high``; what lies outside joins the ends."""
    place = F.floor((key - low) * float(1 << bits) / (high - low + 1))
    return F.least(F.greatest(place, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def row_hash(columns: Sequence[str]) -> Column:
    """60 bits of the md5 of the named values; a null and an empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]
    sizes = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(-1)).cast("string") for c in columns]
    text = F.concat_ws("|", *[part for pair in zip(sizes, parts) for part in pair])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tree(rows: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """(level, node, n, total, mixed) from rows with ``_range`` and ``_hash``; level 0 is the root."""
    held = rows.groupBy(F.col("_range").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_hash").cast("decimal(38,0)")).alias("total"), F.bit_xor("_hash").alias("mixed")
    )
    levels = -(-bits // FAN_BITS)
    # a leaf of each level is its range without the last bits
    at = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    spread = held.select("*", at.alias("level"))
    node = F.expr(f"shiftright(node, (({levels} - level) * {FAN_BITS}))")
    return spread.groupBy("level", node.alias("node")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed")
    )


def publish(df: DataFrame, path: str, key: str, range_of: Column, columns: Sequence[str] | None = None, bits: int = RANGE_BITS) -> None:
    """Write ``df`` and its tree below ``path``; keys must not be null."""
    columns = list(columns or df.columns)
    ranged = required(df, key).select(*columns, range_of.alias("_range"), row_hash(columns).alias("_hash"))
    folder = F.expr(f"shiftright(_range, {max(0, bits - FOLDER_BITS)})").alias("_folder")
    rows = ranged.select("*", folder).repartition("_folder", "_range").sortWithinPartitions("_folder", "_range")
    rows.write.mode("errorifexists").partitionBy("_folder").parquet(f"{path}/rows")
    # an empty table has no row files that would tell its columns
    rows.limit(0).write.mode("errorifexists").parquet(f"{path}/schema")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    tree(stored, bits).write.mode("errorifexists").partitionBy("level").parquet(f"{path}/tree")


def differing_ranges(spark: SparkSession, old: str, new: str, bits: int = RANGE_BITS) -> list[int]:
    """Ranges whose fingerprints differ, found from the root; at most ``2 ** bits`` numbers."""
    trees = [spark.read.schema(TREE).parquet(f"{path}/tree") for path in (old, new)]
    nodes: list[int] | None = None
    for level in range(-(-bits // FAN_BITS) + 1):
        a, b = (t.where(F.col("level") == level).drop("level") for t in trees)
        if nodes is not None:
            children = [n << FAN_BITS | i for n in nodes for i in range(1 << FAN_BITS)]
            a, b = (t.where(F.col("node").isin(children)) for t in (a, b))
        both = a.alias("a").join(b.alias("b"), F.col("a.node") == F.col("b.node"), "full_outer")
        same = F.lit(True)
        for c in ("n", "total", "mixed"):
            same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        nodes = [r["node"] for r in both.where(~same).select(F.coalesce("a.node", "b.node").alias("node")).collect()]
        if not nodes:
            return []
    return sorted(nodes)


def rows_of(spark: SparkSession, path: str, ranges: Sequence[int], bits: int = RANGE_BITS) -> DataFrame:
    """The rows of some ranges; folders and row groups without them are not read."""
    folders = sorted({r >> max(0, bits - FOLDER_BITS) for r in ranges})
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("_folder").isin(folders) & F.col("_range").isin(list(ranges)))


def differences(spark: SparkSession, old: str, new: str, key: str, bits: int = RANGE_BITS) -> DataFrame:
    """(key, status) of every key that was ADDED, REMOVED or CHANGED; a repeated key is compared by all its rows."""
    ranges = differing_ranges(spark, old, new, bits)
    sides = []
    for path in (old, new):
        rows = rows_of(spark, path, ranges, bits)
        sides.append(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_hash").cast("decimal(38,0)")).alias("h")))
    a, b = sides
    both = a.select(key, F.struct("n", "h").alias("_a")).join(b.select(key, F.struct("n", "h").alias("_b")), key, "full_outer")
    status = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("_a") != F.col("_b"), "CHANGED")
    return both.select(key, status.alias("status")).where("status IS NOT NULL")
