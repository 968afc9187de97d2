"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Both token sequences of a text cover the same bytes.  One NumPy state vector
holds the pointers into the A and B tokens of all documents of a batch; each step
emits the pair under the pointers as a link, emits a cut where both tokens end at
the same byte, moves the pointer whose token ends first (both at a cut) and drops
the finished documents from the vector.  A long document has several places in
the vector, one for every ``LANE`` A tokens, each begun at the B token that holds
its first byte, so a step works on many tokens whatever the lengths are.

Counts of id pairs over the corpus are one aggregate.  Pairs above a count that at
most ``FREQUENT`` pairs reach come back to the documents by a broadcast join, the
rest, of which none is frequent, by a shuffled one.

Defined cases: a text that is null or empty, or whose A or B tokens do not spell a
space and the text, has no tokens: zeros and an empty string.  Repeated rows and
rows without an id are documents each.  Texts of any length are encoded piece by
piece, cut before a single space between other characters, where no token of either
vocabulary can reach across (a text without such a space is one piece).  Other
columns are never read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_arrow, slices
from strandline.session import materialise

TOKENIZER_DIR = "/opt/tokenizers"
VERSION_A, VERSION_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
LANE = 256  # A tokens of one place in the state vector
SLICE_BYTES = 1 << 20  # of text that is merged together
PIECE_CHARS = 1 << 17
FREQUENT = 400_000  # pairs that are broadcast: three numbers each

# Fixed value: how a byte-level vocabulary cuts a text before it merges bytes.
_PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEYOND = re.compile("[^\x00-\u02ff]")
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_SEPARATORS = (",", "|", ";")

# real outputs of the operator, by name
COLUMNS = {
    "n_a": "long",
    "n_b": "long",
    "n_groups": "long",
    "n_links": "long",
    "groups_sha256": "string",
    "groups": "string",  # a1,a2|b1;a3|b2: ids of each group
    "a_ids": "array<int>",
    "b_ids": "array<int>",
    "cuts": "array<long>",  # bytes after which both sides have a token end, the leading space included
    "link_a": "array<int>",  # places of linked tokens, in order
    "link_b": "array<int>",
    "pair_a": "array<int>",  # distinct linked ids and how many links they have
    "pair_b": "array<int>",
    "pair_n": "array<int>",
}


# tokenizers -------------------------------------------------------------------------


def byte_characters() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level vocabulary; encodes a space before the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        table = byte_characters()
        words = sorted(self.tokenizer.get_vocab().items(), key=lambda entry: entry[1])
        self.spelled = [b""] * (words[-1][1] + 1)
        for word, at in words:
            self.spelled[at] = bytes(table[c] for c in word) if all(c in table for c in word) else word.encode()
        self.ranked = self._by_rank(path, table)

    def _by_rank(self, path: str, table: dict[str, int]):
        """The same vocabulary for a faster library, where ids are the order of the merges; else none."""
        import tiktoken

        with open(path) as file:
            model = json.load(file)["model"]
        ids, single = model["vocab"], len(table)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(ids[word] != single + i for i, word in enumerate(merged)):
            return None
        ranks = {self.spelled[i]: i for word, i in ids.items() if i < single + len(merged)}
        return tiktoken.Encoding(path, pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that begin with the space before them.

        The libraries know different versions of Unicode; the faster one has the
        pieces in Latin letters, of whose classes there is no doubt.
        """
        out: list[list[int]] = [[]] * len(pieces)
        others = []
        for at, piece in enumerate(pieces):
            if self.ranked is None or _BEYOND.search(piece):
                others.append(at)
            else:
                out[at] = self.ranked.encode_ordinary(piece)
        found = self.tokenizer.encode_batch_fast([pieces[at] for at in others], add_special_tokens=False)
        for at, entry in zip(others, found):
            out[at] = entry.ids
        return out


class Pieces:
    """A vocabulary of pieces with byte fallback; adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.spelled = [
            bytes([int(name[3:5], 16)]) if self.processor.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return self.processor.encode([p[1:] for p in pieces], num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def text_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text after a space, cut before single spaces; every piece begins with its space."""
    text, out, start = " " + text, [], 0
    while start < len(text):
        found = _BREAK.search(text, start + size) if start + size < len(text) else None
        end = found.start() if found else len(text)
        out.append(text[start:end])
        start = end
    return out


def encoded(texts: list[str | None], side, size: int = PIECE_CHARS) -> list[list[int]]:
    """Ids of each text; none where they do not spell a space and the text."""
    pieces = [text_pieces(t, size) if t else [] for t in texts]
    ids = iter(side.encode([p for own in pieces for p in own]))
    spell = side.spelled.__getitem__
    out = []
    for own in pieces:
        all_ids, right = [], True
        for piece in own:
            found = next(ids)
            right = right and b"".join(map(spell, found)) == piece.encode()
            all_ids += found
        out.append(all_ids if right else [])
    return out


# merging ----------------------------------------------------------------------------


def lanes(sizes: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and end of each place in the state vector, for documents of ``sizes`` tokens."""
    parts = -(-sizes // lane)
    doc = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.cumsum(sizes) - sizes
    first = begin[doc] + nth * lane
    return first, np.minimum(first + lane, (begin + sizes)[doc])


def lockstep(len_a: np.ndarray, len_b: np.ndarray, sizes: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b) of tokens whose bytes overlap, and whether both end there; in the order of A, then B.

    ``len_a`` and ``len_b`` are the bytes of all tokens of the batch, document after
    document; ``sizes`` are the documents' A tokens.  A document has as many bytes on either side.
    """
    ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
    a, last = lanes(sizes, lane)
    b = np.searchsorted(ends_b, ends_a[a] - len_a[a], "right")
    links_a, links_b, cuts = [a[:0]], [b[:0]], [np.empty(0, bool)]
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        links_a.append(a)
        links_b.append(b)
        cuts.append(end_a == end_b)
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        live = a < last
        if not live.all():
            a, b, last = a[live], b[live], last[live]
    a, b, cut = np.concatenate(links_a), np.concatenate(links_b), np.concatenate(cuts)
    order = np.argsort(a + b, kind="stable")  # every link moves a pointer, so sums rise along a document
    return a[order], b[order], cut[order]


def _spread(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


class Merged:
    """All outputs for one slice of documents."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], side_a, side_b, lane: int):
        keep = [bool(a) and bool(b) for a, b in zip(ids_a, ids_b)]
        ids_a = [a if k else [] for a, k in zip(ids_a, keep)]
        ids_b = [b if k else [] for b, k in zip(ids_b, keep)]
        self.n_a = np.array([len(a) for a in ids_a], np.int64)
        self.n_b = np.array([len(b) for b in ids_b], np.int64)
        self.a = np.fromiter((i for own in ids_a for i in own), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter((i for own in ids_b for i in own), np.int64, int(self.n_b.sum()))
        self.len_a, self.len_b = _widths(side_a)[self.a], _widths(side_b)[self.b]
        self.doc_a = np.repeat(np.arange(len(ids_a)), self.n_a)
        self.link_a, self.link_b, self.cut = lockstep(self.len_a, self.len_b, self.n_a, lane)
        self.doc = self.doc_a[self.link_a]
        self.n_links = np.bincount(self.doc, minlength=len(ids_a))
        self.n_groups = np.bincount(self.doc[self.cut], minlength=len(ids_a))

    def groups(self) -> list[str]:
        """The ids of each group, as text."""
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.link_a[self.cut]] = 1
        ends_b[self.link_b[self.cut]] = 1
        of_a, of_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        total = int(self.n_groups.sum())
        per_a, per_b = np.bincount(of_a, minlength=total), np.bincount(of_b, minlength=total)
        # a group's A tokens stand before its B tokens, and after all groups before it
        at_a = np.arange(len(self.a)) + _spread(per_b)[of_a]
        at_b = np.arange(len(self.b)) + _spread(per_a)[of_b + 1]
        places = np.empty(len(self.a) + len(self.b), np.int64)
        last_a = np.append(of_a[1:] != of_a[:-1], [True] * bool(len(of_a)))
        places[at_a] = self.a * 3 + last_a
        places[at_b] = self.b * 3 + 2 * ends_b
        written = _written(int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
        ends = _spread(self.n_a + self.n_b)
        return ["".join(map(written.__getitem__, places[s:e].tolist()))[:-1] for s, e in zip(ends[:-1], ends[1:])]

    def lists(self, values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(_spread(sizes).astype(np.int32)), pa.array(values, kind))

    def column(self, name: str) -> pa.Array:
        if name in ("n_a", "n_b", "n_links", "n_groups"):
            return pa.array(getattr(self, name), pa.int64())
        if name == "groups":
            return pa.array(self.groups(), pa.string())
        if name == "groups_sha256":
            return pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in self.groups()], pa.string())
        if name == "a_ids":
            return self.lists(self.a, self.n_a, pa.int32())
        if name == "b_ids":
            return self.lists(self.b, self.n_b, pa.int32())
        if name == "cuts":
            ends = np.cumsum(self.len_a)
            before = np.concatenate([[0], ends])[np.cumsum(self.n_a) - self.n_a]
            at = self.link_a[self.cut]
            return self.lists(ends[at] - before[self.doc_a[at]], self.n_groups, pa.int64())
        if name in ("link_a", "link_b"):
            sizes = self.n_a if name == "link_a" else self.n_b
            return self.lists(getattr(self, name) - (np.cumsum(sizes) - sizes)[self.doc], self.n_links, pa.int32())
        return self.pairs()[("pair_a", "pair_b", "pair_n").index(name)]

    def pairs(self) -> tuple[pa.Array, pa.Array, pa.Array]:
        if not hasattr(self, "_pairs"):
            wide = int(self.b.max(initial=0)) + 1
            ids = self.a[self.link_a] * wide + self.b[self.link_b]
            codes, times, sizes = [ids[:0]], [ids[:0]], []
            ends = _spread(self.n_links)
            for s, e in zip(ends[:-1], ends[1:]):
                code, n = np.unique(ids[s:e], return_counts=True)
                codes.append(code)
                times.append(n)
                sizes.append(len(code))
            code, sizes = np.concatenate(codes), np.array(sizes, np.int64)
            self._pairs = tuple(
                self.lists(v, sizes, pa.int32()) for v in (code // wide, code % wide, np.concatenate(times))
            )
        return self._pairs


@lru_cache(maxsize=4)
def _widths(side) -> np.ndarray:
    return np.array([len(s) for s in side.spelled], np.int64)


@lru_cache(maxsize=4)
def _written(bits: int) -> list[str]:
    """Each id below the power of two with each separator after it."""
    return [f"{i}{s}" for i in range(1 << bits) for s in _SEPARATORS]


def align(
    docs: DataFrame,
    outputs: tuple[str, ...] = ("a_ids", "b_ids", "cuts", "link_a", "link_b"),
    id_col: str = "doc_id",
    text_col: str = "text",
    version_a: str = VERSION_A,
    version_b: str = VERSION_B,
    directory: str = TOKENIZER_DIR,
    lane: int = LANE,
) -> DataFrame:
    """``doc_id`` and the chosen ``outputs`` (see ``COLUMNS``) of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = tokenizer(f"{directory}/{version_a}"), tokenizer(f"{directory}/{version_b}")
        for batch in slices(batches, size=SLICE_BYTES):
            texts = batch.column(1).to_pylist()
            found = Merged(encoded(texts, side_a), encoded(texts, side_b), side_a, side_b, lane)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(found.column, outputs)], names=["doc_id", *outputs])

    return in_arrow(source, work, ", ".join(["doc_id long", *(f"{n} {COLUMNS[n]}" for n in outputs)]))


# corpus-wide counts -----------------------------------------------------------------


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best): links that hold each id pair linked, and whether no A id has more with that B id."""
    counts = materialise(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    # a row for each id of the B vocabulary at most
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def frequent_count(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach in count."""
    by_power = counts.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    above = 0
    for power, n in sorted(by_power, reverse=True):
        above += n
        if above > limit:
            return 2 ** (power + 1)
    return 1


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, **options) -> DataFrame:
    """Per row: numbers of tokens, groups and links, how many links are their B id's best, and the sum of the links' counts."""
    outputs = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair_a", "pair_b", "pair_n")
    rows = align(docs, outputs, id_col, text_col, **options).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "aligned")
    links = rows.select("row", F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n"))).toDF("row", "a", "b", "n")
    counts = materialise(pair_counts(links), "pair-scores")
    least = frequent_count(counts, frequent)
    often, seldom = counts.where(F.col("count") >= least), counts.where(F.col("count") < least)
    sums = (F.sum(F.col("n") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    scores = links.join(F.broadcast(often), ["a", "b"]).groupBy("row").agg(*sums)
    if least > 1:
        left = links.join(F.broadcast(often.select("a", "b")), ["a", "b"], "left_anti")
        rare = left.join(seldom.hint("merge"), ["a", "b"]).groupBy("row").agg(*sums)
        scores = scores.unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return rows.join(scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
