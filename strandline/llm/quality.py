"""Quality scores from a factorisation machine.

Features of a text are its distinct words, hashed into ``BINS`` bins, a few
statistics of its structure, and as metadata its stated length against the true
one.  The model adds to the linear part a pairwise part with one short vector
per feature; since the sum over pairs is half of (square of the sum minus sum of
the squares), a text is scored in time linear in its features.

The model is fitted on at most ``MAX_FIT_ROWS`` labelled documents, those with
the smallest hash of the id, in one task; only the weights reach the driver.
Everything else runs over all rows.

Defined cases: null text is empty text and is scored from its structure alone.
Repeated rows get equal scores; repeated labels of one document count once
(highest label).  Without any labelled row every score is 0.5.  An existing
column named like an output column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_arrow, per_group, slices
from strandline.session import ship

BINS = 1 << 15
RANK = 4
MAX_FIT_ROWS = 8_000
THRESHOLD = 0.7
EPOCHS, RATE, PENALTY, BATCH = 12, 0.1, 1e-4, 64
WINDOW = 48  # words of a stretch whose worst structure counts

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
STATISTICS = 17


def _shares(words: list[str]) -> tuple[float, float, float, float, float]:
    """Of some words: shares of repeats of the word before, of distinct words, of signs, of capitals, of long words."""
    n = len(words)
    data = "".join(words).encode("utf-8", "surrogatepass")
    size = max(1, len(data))
    again = sum(map(eq, words, words[1:])) / max(1, n - 1)
    signs = (len(data) - len(data.translate(None, _MARK))) / size
    capitals = (len(data) - len(data.translate(None, _UPPER))) / size
    return again, len(set(words)) / n, signs, capitals, size / n / 40


def statistics(text: str, words: list[str], stated: int | None) -> list[float]:
    """Structure of a text, each number about 0 to 1; the order is part of the model."""
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (STATISTICS - 1)
    data = text.encode("utf-8", "surrogatepass")
    lines = text.split("\n")
    again, distinct, signs, capitals, long = _shares(words)
    starts = range(0, max(1, n - WINDOW // 2), WINDOW)
    parts = [_shares(words[i:end]) for i, end in zip(starts, [*starts[1:], n])]  # a short rest joins the last one
    digits = (len(data) - len(data.translate(None, _DIGIT))) / len(data)
    return [
        0.0,
        min(1.0, np.log1p(n) / 12),
        again,
        distinct,
        min(1.0, 4 * signs),
        capitals,
        min(1.0, long),
        digits,
        min(1.0, len(lines) / n),
        len(set(lines)) / len(lines),
        max(p[0] for p in parts),
        min(p[1] for p in parts),
        min(1.0, 4 * max(p[2] for p in parts)),
        max(p[3] for p in parts),
        sum(p[2] > 0.1 for p in parts) / len(parts),
        sum(p[3] > 0.5 or p[0] > 0.3 or p[1] < 0.4 for p in parts) / len(parts),
        0.0 if stated is None else min(1.0, abs(stated - len(text)) / (len(text) + 1)),
    ]


def features(text: str | None, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one text; words first, then statistics."""
    words = (text or "").split()
    bins = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(words)), np.int64) % BINS)
    stats = np.array([1.0, *statistics(text or "", words, stated)])
    at = np.flatnonzero(stats)
    index = np.concatenate([bins, BINS + at]).astype(np.int32)
    value = np.concatenate([np.full(len(bins), 1 / np.sqrt(max(1, len(bins)))), stats[at]]).astype(np.float32)
    return index, value


SIZE = BINS + 1 + STATISTICS


@dataclass
class Machine:
    """Weights of the linear part and one short vector per feature."""

    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def blank(cls) -> Machine:
        start = np.random.default_rng(7).normal(0, 0.02, (SIZE, RANK)).astype(np.float32)
        return cls(np.zeros(SIZE, np.float32), start)

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of several rows laid end to end, and the factor sums that give them."""
        moved = self.factors[index] * value[:, None]
        sums = np.add.reduceat(moved, starts, axis=0)
        squares = np.add.reduceat(moved * moved, starts, axis=0)
        pairs = 0.5 * (sums * sums - squares).sum(axis=1)
        return np.add.reduceat(self.linear[index] * value, starts) + pairs, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Machine:
    """Minimise logistic loss over (label, index, value) rows by adaptive steps; the order of rows is fixed by a seed."""
    model = Machine.blank()
    if not rows:
        model.factors[:] = 0
        return model
    rng = np.random.default_rng(11)
    seen_linear, seen_factors = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            labels = np.array([r[0] for r in part], np.float32)
            sizes = np.array([len(r[1]) for r in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index, value = np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])
            margin, sums = model.margins(index, value, starts)
            error = np.repeat((sigmoid(margin) - labels) / len(part), sizes).astype(np.float32)
            names, place = np.unique(index, return_inverse=True)
            slope = np.bincount(place, error * value, len(names)).astype(np.float32) + PENALTY * model.linear[names]
            pull = value[:, None] * np.repeat(sums, sizes, axis=0) - model.factors[index] * (value * value)[:, None]
            pull *= error[:, None]
            slopes = np.stack([np.bincount(place, pull[:, f], len(names)) for f in range(RANK)], axis=1).astype(np.float32)
            slopes += PENALTY * model.factors[names]
            seen_linear[names] += slope * slope
            seen_factors[names] += slopes * slopes
            model.linear[names] -= RATE * slope / np.sqrt(seen_linear[names])
            model.factors[names] -= RATE * slopes / np.sqrt(seen_factors[names])
    return model


def held_out(id_col: str) -> Column:
    """Rows whose labels are never used for fitting."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = "n_chars",
    label_col: str = "quality",
    max_rows: int = MAX_FIT_ROWS,
) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out ids."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    stated = F.col(length_col).cast("long") if length_col and length_col in docs.columns else F.lit(None).cast("long")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"), stated.alias("stated"))
    # at most max_rows rows on the right
    source = source.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "stated", "body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [features(t, s) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)] + [pa.array([m[i].tobytes() for m in made], pa.binary()) for i in (0, 1)],
                names=["doc_id", "y", "index", "value"],
            )

    rows = in_arrow(source, work, "doc_id long, y int, index binary, value binary").groupBy("doc_id").agg(
        F.min(F.struct("y", "index", "value")).alias("r")
    )

    def work_all(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda row: row["doc_id"])
        made = [row["r"] for row in got]
        model = fit([(r["y"], np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in made])
        return pa.table({"linear": [model.linear.tobytes()], "factors": [model.factors.tobytes()]})

    # one group of at most max_rows rows
    fitted = per_group(rows.withColumn("one", F.lit(1)), ["one"], work_all, "linear binary, factors binary").first()
    if fitted is None:
        return fit([])
    return Machine(np.frombuffer(fitted["linear"], np.float32), np.frombuffer(fitted["factors"], np.float32).reshape(SIZE, RANK))


def scores(model: Machine, texts: list[str | None], stated: list[int | None]) -> np.ndarray:
    made = [features(t, s) for t, s in zip(texts, stated)]
    if not made:
        return np.empty(0)
    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in made])[:-1]])
    margin, _ = model.margins(np.concatenate([i for i, _ in made]), np.concatenate([v for _, v in made]), starts)
    return np.round(sigmoid(margin.astype(np.float64)), 6)


def score(docs: DataFrame, model: Machine, keep: tuple[str, ...], text_col: str = "text", length_col: str | None = "n_chars", out: str = "score") -> DataFrame:
    """``keep`` and the score of every row."""
    keep = tuple(c for c in keep if c != out)
    stated = F.col(length_col).cast("long") if length_col and length_col in docs.columns else F.lit(None).cast("long")
    source = docs.select(*keep, F.col(text_col).alias("_body"), stated.alias("_stated"))
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = scores(sent.value, batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.float64())], names=[*keep, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)]]
    return in_arrow(source, work, ", ".join([*fields, f"`{out}` double"]))


def keep_good(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents that score at least ``threshold``; all columns stay."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    has_length = length_col in docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            stated = batch.column(batch.schema.get_field_index(length_col)).to_pylist() if has_length else [None] * len(texts)
            yield batch.filter(pa.array(scores(sent.value, texts, stated) >= threshold))

    return in_arrow(docs, work, docs.schema)
