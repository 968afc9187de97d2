"""Token counts kept as rollups that change by signed deltas.

Every change of a document adds signed rows to a ledger: minus the row that was
live, plus the row that is live now.  The ledger is cut into buckets by document,
so a batch reads the buckets of its own documents only.  With its signed rows a
batch writes its rollup: the signed change of documents and tokens by source,
language and tokenizer version.  Totals are the last compacted totals plus the
rollups of the batches since; no signed row is read for them.

A batch counts from the moment its marker exists; committing the same batch again
does nothing, and what a batch wrote that never got its marker is not read and is
overwritten by the next attempt.  Compacted totals name the batches they hold, so
a batch counts once, whatever was compacted when.  One writer commits at a time.

Defined cases: a null text has no tokens.  Null source or language is a group of
its own.  Of several changes to one document and version in a batch, the one
with the largest ``seq`` counts (equal ones: the largest remaining values).
Inserting a live document or revising an unknown one sets its state; deleting
an unknown one does nothing.  A row without ``doc_id`` has no state to look up:
its inserts add up, its revisions and deletes are ignored.  Empty batches commit.
Very long texts are counted one at a time.  Kept columns may have any name but
those of the results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import free_name, in_arrow, slices
from strandline.session import materialise

TOKENIZER_DIR = "/opt/tokenizers"
VERSION = "byte_bpe_50k"
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

STATE = ["doc_id", "tokenizer_version", "source", "lang", "n_tokens"]
GROUP = ["source", "lang", "tokenizer_version"]
SIGNED = "doc_id long, tokenizer_version string, source string, lang string, n_tokens long, sign int"
ROLLUP = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
BUCKETS = 64  # parts of the ledger; a small batch reads a part for each of its documents
COMPACT_EVERY = 32  # batches whose rollups are read one by one


@lru_cache(maxsize=4)
def encoding(directory: str, version: str):
    """The tokenizer in ``<directory>/<version>.tiktoken``, loaded once per worker."""
    import tiktoken

    with open(f"{directory}/{version}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(version, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id", "source", "lang"),
    version: str = VERSION,
    directory: str = TOKENIZER_DIR,
) -> DataFrame:
    """``keep``, ``tokenizer_version`` and ``n_tokens`` of every whole text."""
    source = docs.select(*keep, F.col(text_col).cast("string").alias(free_name(list(keep), "body")))
    at = len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(directory, version).encode_ordinary
        for batch in slices(batches):
            counts = [len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:at]]
    return in_arrow(source, work, ", ".join([*fields, "n_tokens long"])).withColumn("tokenizer_version", F.lit(version))


class TokenLedger:
    """The signed rows, rollups and committed batches below one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.buckets, self.compact_every = spark, root.rstrip("/"), buckets, compact_every

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, files = self._path(folder)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def _mark(self, name: str) -> None:
        marker, files = self._path(name)
        files.create(marker, False).close()

    def batches(self) -> list[str]:
        """Committed batches; one short name each."""
        return self._names("commits")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def signed(self, touched: list[int] | None = None) -> DataFrame | None:
        """Signed rows of all committed batches, or of those of their buckets that are ``touched``."""
        paths = [f"{self.root}/signed/{b}" for b in self.batches()]
        if not paths:
            return None
        parts = [self.spark.read.schema(f"{SIGNED}, bucket int").option("basePath", p).parquet(p) for p in paths]
        rows = reduce(DataFrame.unionByName, parts)
        return rows if touched is None else rows.where(F.col("bucket").isin(touched))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before.

        ``changes`` holds ``op`` (insert, revise or delete), ``seq`` and the columns of STATE.
        """
        if batch in self.batches():
            return False
        # several uses below; counting tokens again would cost more than the narrow rows
        changes = materialise(changes.select("op", "seq", *STATE), "changes")
        alive = F.col("op") != "delete"
        state = F.struct("seq", (~alive).alias("gone"), "n_tokens", "source", "lang")
        last = (
            changes.where("doc_id IS NOT NULL")
            .groupBy("doc_id", "tokenizer_version")
            .agg(F.max(state).alias("s"))
            .select("doc_id", "tokenizer_version", "s.gone", "s.source", "s.lang", "s.n_tokens")
        )
        plus = last.where("NOT gone").select(*STATE).withColumn("sign", F.lit(1))
        nameless = changes.where(F.col("doc_id").isNull() & (F.col("op") == "insert"))
        rows = plus.unionByName(nameless.select(*STATE).withColumn("sign", F.lit(1)))
        # at most as many numbers as there are buckets
        touched = [r["b"] for r in changes.where("doc_id IS NOT NULL").select(self.bucket().alias("b")).distinct().collect()]
        before = self.signed(touched)
        if before is not None and touched:
            mine = last.select("doc_id", "tokenizer_version")
            live = (
                before.join(mine, ["doc_id", "tokenizer_version"], "left_semi")
                .groupBy(*STATE)
                .agg(F.sum("sign").alias("n"))
                .where("n > 0")
            )
            rows = rows.unionByName(live.select(*STATE, (-F.col("n")).cast("int").alias("sign")))
        # a row that goes and comes back unchanged cancels
        rows = rows.groupBy(*STATE).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        rows = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        written = f"{self.root}/signed/{batch}"
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(written)
        signed = self.spark.read.schema(SIGNED).parquet(written)
        added_up(signed, F.col("sign"), F.col("sign") * F.col("n_tokens")).write.mode("overwrite").parquet(f"{self.root}/rollups/{batch}")
        self._mark(f"commits/{batch}")
        if len(self.batches()) - len(self._compacted()[1]) >= self.compact_every:
            self.compact()
        return True

    def _compacted(self) -> tuple[str | None, set[str]]:
        """Folder of the last finished compaction, and the batches it holds."""
        done = self._names("compactions")
        if not done:
            return None, set()
        folder = f"{self.root}/compacted/{done[-1]}"
        return f"{folder}/totals", {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{folder}/batches").collect()}

    def _rollup(self) -> DataFrame:
        folder, held = self._compacted()
        paths = [f"{self.root}/rollups/{b}" for b in self.batches() if b not in held] + ([folder] if folder else [])
        if not paths:
            raise ValueError("no batch was committed")
        rows = self.spark.read.schema(ROLLUP).parquet(*paths)
        return added_up(rows, F.col("n_docs"), F.col("n_tokens"))

    def compact(self) -> None:
        """Write the totals of all committed batches as one table; a run that fails leaves the last one in use."""
        held = self.batches()
        name = f"{len(self._names('compactions')):08d}"
        folder = f"{self.root}/compacted/{name}"
        self._rollup().write.mode("overwrite").parquet(f"{folder}/totals")
        self.spark.createDataFrame([(b,) for b in held], "batch string").write.mode("overwrite").parquet(f"{folder}/batches")
        self._mark(f"compactions/{name}")

    def totals(self) -> DataFrame:
        """Additive totals of the committed batches; groups that fell to nothing are left out."""
        return self._rollup().where("n_docs <> 0 OR n_tokens <> 0")


def added_up(rows: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))
