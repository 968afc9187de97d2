"""Exact copies by progressive refinement: length, then a hash of the prefix, then a hash of the whole.

Texts are equal when they are identical after lower-casing A to Z.  One pass
over the table notes the length in bytes and the hash of the first characters of
every row.  Lengths that occur once settle their rows; of the rest, so do pairs
of length and prefix that occur once.  The surviving pairs mark a bit map, whose
size is bounded; the second pass tests each row's pair in it and hashes the
whole text of the rows that hit.  A pair that hits by chance only costs one more
hash: rows are grouped by length and whole hash in the end.  Texts are never
shuffled, and groups are added up before they are, so a group of copies of any
size costs what its rows cost.

All of it is DataFrame code.

Defined cases: a null text counts as empty, and empty texts are equal.  Of equal
texts, the row with the largest id stays; rows without an id are outlived by any
with one.  Of equal rows with one id (or none), one stays.  Very long texts are
hashed where they are read.  Other columns are never read, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import free_name
from strandline.operators.skew import lookup_join
from strandline.session import materialise

PREFIX_CHARS = 64
BITS_PER_KEY = 16
PAGE_BITS = 32_768  # bits of one row of the bit map, as Spark's bitmap functions deal them
MAX_PAGES = 8_192  # 32 MB


def normalised(text: Column) -> Column:
    """The text with A to Z in lower case; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text.cast("string"), F.lit("")))


def _prefix(text: Column) -> Column:
    return F.xxhash64(normalised(F.substring(text.cast("string"), 1, PREFIX_CHARS)))


def suspects(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Pairs (n_bytes, prefix) that several rows share."""
    text = F.col(text_col)
    sizes = materialise(docs.select(_length(text).alias("n_bytes"), _prefix(text).alias("prefix")), "exact-sizes")
    lengths = sizes.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes")
    left = lookup_join(sizes, materialise(lengths, "exact-lengths"), ["n_bytes"], "left_semi")
    return left.groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes", "prefix")


def _slot(pages: int) -> Column:
    """Place of a pair in the bit map, from one."""
    return F.pmod(F.xxhash64("n_bytes", "prefix"), F.lit(pages * PAGE_BITS).cast("long")) + 1


def bit_map(keys: DataFrame) -> tuple[DataFrame, int]:
    """(page, bits) rows marked by the pairs of ``keys``, and how many pages there may be."""
    pages = 1
    wanted = keys.count() * BITS_PER_KEY // PAGE_BITS
    while pages < min(wanted, MAX_PAGES):
        pages *= 2
    slot = _slot(pages)
    marked = keys.groupBy(F.bitmap_bucket_number(slot).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    return marked, pages


def hashed(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """(doc_id, n_bytes, found, digest): the whole hash of every row whose pair may be in ``keys``.

    ``digests`` asks for the hash of the settled rows too; it has no part in the grouping.
    """
    bits, pages = bit_map(keys)
    text, slot = F.col("body"), _slot(pages)
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
        .withColumns({"n_bytes": _length(text), "prefix": _prefix(text)})
        .withColumn("page", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bits), "page", "left")
        .withColumn("found", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    )
    wanted = F.lit(True) if digests else F.col("found")
    digest = F.when(wanted, F.unhex(F.sha2(normalised(text).cast("binary"), 256)))
    return rows.select("doc_id", "n_bytes", "found", digest.alias("digest"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    ``digest`` is the SHA-256 of the normalised text; without ``digests`` it is
    null where length and prefix settled the row.
    """
    keys = materialise(suspects(docs, text_col), "exact-suspects")
    rows = materialise(hashed(docs, keys, id_col, text_col, digests), "exact-hashes")
    names = rows.where("found").groupBy("n_bytes", "digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = names.groupBy("n_bytes", "digest").agg(F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    groups = materialise(groups.where("group_size > 1"), "exact-groups")
    alone = F.col("group_size").isNull()
    member = lookup_join(names, groups, ["n_bytes", "digest"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
        "digest",
    )
    member = member.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
    settled = rows.where("NOT found").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return settled.unionByName(member.select(*settled.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    name = free_name(docs.columns, "row_key")

    def key(digest: Column, doc_id: Column) -> Column:
        return F.concat_ws(":", digest, doc_id.cast("string"))

    found = copies(docs, id_col, text_col).where("group_size > 1")
    found = found.groupBy(key(F.hex("digest"), F.col("doc_id")).alias(name)).agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")
    )
    found = materialise(found, "exact-keys")
    digest = F.upper(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    rows = docs.withColumn(name, key(digest, F.col(id_col)))
    whole = lookup_join(rows, found.where("NOT kept OR n > 1").select(name), [name], "left_anti")
    repeated = lookup_join(rows, found.where("kept AND n > 1").select(name), [name], "left_semi").dropDuplicates([name])
    return whole.unionByName(repeated).drop(name)


def copies_sql() -> str:
    """The rows of the query in DuckDB SQL."""
    return f"""
        WITH texts AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')) AS digest
            FROM documents
        ), ranked AS (
            SELECT doc_id, digest, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                row_number() OVER (PARTITION BY digest, doc_id) AS copy
            FROM texts WINDOW same AS (PARTITION BY digest)
        )
        SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id) AND copy = 1 AS kept, digest AS text_sha256
        FROM ranked"""
