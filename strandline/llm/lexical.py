"""Ranked lexical search: LEMP-style buckets of impact vectors.

A document is the vector of the impacts of its terms, an item the vector of
its terms' weights, and the score is their inner product.  Vectors are dealt to
tasks by length, longest first, and cut into buckets of similar length.  By
Cauchy-Schwarz no document of a bucket can score more than the item's length
times the largest length in it; a bucket below the item's tenth best score so
far is left.  Inside a bucket the coordinates of the item are taken in order of
weight: what a document has there, plus the lengths of what is left of both
vectors, bounds its score.  Documents whose bound reaches the tenth best are
scored exactly, in 64-bit integers, from their whole vector.

The longest documents are searched first; their tenth best scores are where the
tasks of all others begin.  Only coordinates that some item has can add to a
score, so only these are kept.  Items are worked off in blocks of a bounded
number of terms: all documents are read for each block, and the driver holds the
terms of one block.

Defined cases: null and empty texts have no terms.  A document without an id
counts in the statistics and is not ranked; rows that share an id are documents
each.  Rows of one item id are one item with the terms of all, a null id included.
Ties rank by ascending id.  Texts of any length are read piece by piece; a term of
more than 64 bytes is known by its SHA-256.  Empty tables give no rows; other
columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import in_arrow, slices
from strandline.session import materialise

TOP = 10
BLOCK_TERMS = 250_000  # terms of the items that are searched together
BUCKET = 2_048  # documents of a bucket
FOCUS = 4  # coordinates taken before the bounds are looked at again
FEW = 0.02  # share of a bucket's documents that is scored without another look
LONGEST = 1 / 32  # share of the documents that is searched first
SLACK = 1 + 1e-9  # above the rounding of sums of squares

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
PIECE = 1 << 20
LONG_TERM = 64


def _key(term: bytes) -> bytes:
    """A term, or a mark that is no term and its digest."""
    return term if len(term) <= LONG_TERM else b" " + hashlib.sha256(term).digest()


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs in the whole text."""
    found: Counter = Counter()
    start, text = 0, text or b""
    while start < len(text):
        gap = _GAP.search(text, start + PIECE) if start + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        found.update(_TERM.findall(text[start:end].lower()))
        start = end
    for term in [t for t in found if len(t) > LONG_TERM]:
        found[_key(term)] += found.pop(term)
    return found


# items ------------------------------------------------------------------------------


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    source = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms = [list(term_counts(t)) for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(batch.num_rows), [len(t) for t in terms])
            flat = pa.array([t for own in terms for t in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), flat], names=["item_id", "term"])

    kind = source.schema["item_id"].dataType.simpleString()
    return in_arrow(source, work, f"item_id {kind}, term binary").distinct()


@dataclass
class Block:
    """The items that are searched together: ids, vocabulary and the terms of each as places in it."""

    ids: pa.Array
    vocabulary: dict[bytes, int]
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def of(cls, rows: pa.Table) -> Block:
        terms = rows.column("term").to_pylist()
        vocabulary = {t: i for i, t in enumerate(sorted(set(terms)))}
        names = rows.column("item_id").combine_chunks().dictionary_encode("encode")
        owner = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        places = np.array([vocabulary[t] for t in terms], np.int64)[order]
        starts = np.searchsorted(owner[order], np.arange(len(names.dictionary) + 1))
        return cls(names.dictionary, vocabulary, starts, places)

    def weigh(self, df: np.ndarray, documents: int) -> None:
        """Weights of the vocabulary; the terms of each item are then ordered by weight, largest first."""
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        for at in range(len(self.ids)):
            mine = slice(self.starts[at], self.starts[at + 1])
            self.terms[mine] = self.terms[mine][np.argsort(-self.weights[self.terms[mine]], kind="stable")]


# documents --------------------------------------------------------------------------


def vectors(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms; ``terms`` are places in the broadcast vocabulary."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in slices(batches):
            sizes, ends, places, tfs = [], [0], [], []
            for text in batch.column(1).to_pylist():
                counts = term_counts(text)
                sizes.append(counts.total())
                for term in counts.keys() & known.keys():
                    places.append(known[term])
                    tfs.append(counts[term])
                ends.append(len(places))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(places, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return in_arrow(source, work, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero and values of a list column."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten().to_numpy()


def impacts(rows: DataFrame, documents: int, terms: int) -> DataFrame:
    """(doc_id, norm, terms, impacts) of the documents that have an id and some term of an item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(1).to_numpy()
            if int(n.max()) * 90 * documents >= 1 << 63:
                n = n.astype(object)
            m = (10 + 90 * n * documents // terms).astype(np.int64)
            offsets, tfs = _lists(batch.column(3))
            tfs = tfs.astype(np.int64)
            value = 1_000_000_000 * tfs // (1000 * tfs + 8 * np.repeat(m, np.diff(offsets)))
            running = np.concatenate([[0.0], np.cumsum(value.astype(float) ** 2)])
            ends = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    # differences of running sums are rounded; lengths may only be too large
                    pa.array(np.sqrt((running[offsets[1:]] - running[offsets[:-1]]) + running[-1] * 1e-12)),
                    pa.ListArray.from_arrays(ends, batch.column(2).flatten()),
                    pa.ListArray.from_arrays(ends, pa.array(value.astype(np.int32))),
                ],
                names=["doc_id", "norm", "terms", "impacts"],
            )

    some = rows.where("doc_id IS NOT NULL AND size(terms) > 0")
    return in_arrow(some, work, "doc_id long, norm double, terms array<int>, impacts array<int>")


# search -----------------------------------------------------------------------------


class Bucket:
    """Documents of similar length: their vectors by document and by coordinate."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.ids, self.norms = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        self.offsets, self.terms = _lists(batch.column(2))
        self.values = _lists(batch.column(3))[1].astype(np.int64)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
        order = np.argsort(self.terms, kind="stable")
        self.owner, self.by_term = owner[order], self.values[order].astype(float)
        self.starts = np.searchsorted(self.terms[order], np.arange(size + 1))
        self.longest = float(self.norms.max())

    def survivors(self, terms: np.ndarray, weights: np.ndarray, floor: float) -> np.ndarray:
        """Documents whose bound reaches ``floor``; ``terms`` by falling weight."""
        have = np.zeros(len(self.ids))
        left = self.norms**2 * SLACK
        rest = float((weights.astype(float) ** 2).sum())
        alive = np.ones(len(self.ids), bool)
        for first in range(0, len(terms), FOCUS):
            for term, weight in zip(terms[first : first + FOCUS], weights[first : first + FOCUS].astype(float)):
                at = slice(self.starts[term], self.starts[term + 1])
                rows, value = self.owner[at], self.by_term[at]
                have[rows] += weight * value
                left[rows] -= value * value
                rest -= weight * weight
            bound = have + np.sqrt(max(rest, 0.0) * np.maximum(left, 0.0))
            alive = bound * SLACK >= floor
            if alive.sum() <= FEW * len(alive):
                break
        return np.flatnonzero(alive)

    def scores(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows``; ``weights`` are by coordinate, zero where the item has none."""
        sizes = self.offsets[rows + 1] - self.offsets[rows]
        firsts = np.cumsum(sizes) - sizes
        at = np.repeat(self.offsets[rows] - firsts, sizes) + np.arange(int(sizes.sum()))
        return np.add.reduceat(weights[self.terms[at]] * self.values[at], firsts)


def search(rows: DataFrame, block, floors: np.ndarray, k: int, item_kind: str) -> DataFrame:
    """(item_id, doc_id, score): of each task, what may be among the best ``k`` of an item.

    ``floors`` are scores that ``k`` documents of an item are known to reach.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Block = block.value
        n, size = len(items.ids), len(items.vocabulary)
        lists = [items.terms[items.starts[i] : items.starts[i + 1]] for i in range(n)]
        lengths = np.array([np.sqrt((items.weights[t].astype(float) ** 2).sum()) for t in lists])
        floor = floors.astype(float)
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n
        dense = np.zeros(size, np.int64)
        for batch in slices(batches, BUCKET):
            if not batch.num_rows:
                continue
            if not (lengths * float(batch.column(1).to_numpy().max()) * SLACK >= floor).any():
                continue
            bucket = Bucket(batch, size)
            for i in np.flatnonzero(lengths * bucket.longest * SLACK >= floor):
                terms = lists[i]
                weights = items.weights[terms]
                found = bucket.survivors(terms, weights, floor[i])
                if not len(found):
                    continue
                dense[terms] = weights
                score = bucket.scores(found, dense)
                dense[terms] = 0
                good = score >= floor[i]
                score = np.concatenate([best[i][0], score[good]])
                ids = np.concatenate([best[i][1], bucket.ids[found[good]]])
                first = np.lexsort((ids, -score))[:k]
                best[i] = score[first], ids[first]
                if len(first) == k:
                    floor[i] = max(floor[i], best[i][0][-1])
        owner = np.repeat(np.arange(n), [len(b[0]) for b in best])
        if len(owner):
            yield pa.RecordBatch.from_arrays(
                [
                    items.ids.take(pa.array(owner)),
                    pa.array(np.concatenate([b[1] for b in best])),
                    pa.array(np.concatenate([b[0] for b in best])),
                ],
                names=["item_id", "doc_id", "score"],
            )

    # ties of length, as copies have, are dealt on by id
    dealt = rows.repartitionByRange(F.col("norm").desc(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("norm").desc())
    return in_arrow(dealt, work, f"item_id {item_kind}, doc_id long, score long")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark: SparkSession, docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    block = Block.of(wanted.select("item_id", "term").toArrow())
    kind = wanted.schema["item_id"].dataType.simpleString()
    context = spark.sparkContext
    rows = materialise(vectors(docs, context.broadcast(block.vocabulary), id_col, text_col), "lexical-terms")
    documents, terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    # as many rows as the block has terms
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    block.weigh(df, documents)
    shared = context.broadcast(block)
    points = materialise(impacts(rows, documents, terms), "lexical-impacts")
    floors = np.ones(len(block.ids), np.int64)
    cut = points.agg(F.percentile_approx("norm", 1 - LONGEST, 1000)).first()[0] or 0.0
    first = materialise(search(points.where(F.col("norm") >= cut), shared, floors, k, kind), "lexical-first")
    reached = best_of(first, k).where(F.col("rank") == k).select("item_id", "score").toArrow()
    at = {item: i for i, item in enumerate(block.ids.to_pylist())}
    for item, score in zip(reached.column("item_id").to_pylist(), reached.column("score").to_pylist()):
        floors[at[item]] = score
    rest = search(points.where(F.col("norm") < cut), shared, floors, k, kind)
    return materialise(best_of(first.unionByName(rest), k), "lexical-best")


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents of every item."""
    spark = docs.sparkSession
    wanted = materialise(item_terms(items, item_id, item_text), "lexical-items")
    blocks = max(1, -(-wanted.count() // block_terms))
    dealt = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = None
    for at in range(blocks):
        part = _search_block(spark, docs, dealt.where(F.col("block") == at), k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_sql(k: int = TOP) -> str:
    """The rows of the query in DuckDB SQL."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = r"regexp_extract_all({}, '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"
    of = lambda column: terms.format(lower.format(column))
    return f"""
        WITH found AS (SELECT doc_id, {of("text")} AS terms FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        doc AS (SELECT doc_id, len(terms) AS n FROM found WHERE len(terms) > 0),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM found) GROUP BY ALL),
        total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM doc),
        item AS (SELECT DISTINCT item_id, unnest({of("text")}) AS term FROM benchmark),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        weight AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, total),
        impact AS (
            SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt)) AS x
            FROM tf JOIN doc USING (doc_id), total
        ),
        score AS (
            SELECT item_id, doc_id, sum(w * x)::BIGINT AS score
            FROM item JOIN weight USING (term) JOIN impact USING (term) GROUP BY ALL HAVING sum(w * x) > 0
        )
        SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM score
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= {k}"""
