"""Benchmark items that occur in documents with few edits.

Texts are lower-cased and cut into words at white space and ASCII punctuation.
An item of n words may occur with up to ``k = floor(rate * n)`` word edits.  It
is split into k + 1 pieces; at least one of them must occur unchanged, so exact
piece hits (one automaton over all pieces) give every candidate place, and
Myers' bit-parallel distance, with words as symbols, decides it.

Items are sent to the tasks in blocks of about ``block_items``.  Documents are read
once: a task holds some megabytes of them and takes one block after the other, so
neither it nor the driver ever holds more than one block, and the benchmark may
have any size.

Defined cases: null or empty texts match nothing.  Items of less than seven words
allow no edit and are sought exactly; whether short ones are evidence enough to
drop a document is the caller's choice (``min_words``; ``drop_contaminated`` asks
for five).  Repeated items count once; of several texts of one item the best match
counts.  Repeated documents give repeated rows, empty tables none.  Texts of any
length are searched whole; a task holds the word list of one text.  Other columns
are never read, whatever their names, and ``drop_contaminated`` hands them on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import in_arrow, slices
from strandline.session import materialise

RATE = 0.15
EVIDENCE_WORDS = 5
BLOCK_ITEMS = 5_000
TEXT_BYTES = 32 << 20  # of documents that a task holds while it takes block after block
_MARKS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[str]:
    # one character per byte, so that the automaton and the words agree on places
    line = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_MARKS).split())
    return line.decode("latin-1").split(" ") if line else []


def distance(item: list[str], words: list[str]) -> tuple[int, int]:
    """Fewest edits that turn some run of ``words`` into ``item``, and where the first such run ends."""
    last = 1 << (len(item) - 1)
    full = (last << 1) - 1
    places: dict[str, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    plus, minus, score = full, 0, len(item)
    best = (score, 0)
    for j, w in enumerate(words):
        same = places.get(w, 0)
        level = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(across | plus))
        down = plus & across
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(level | up))
        minus = up & level
        if score < best[0]:
            best = (score, j + 1)
    return best


class Finder:
    """All pieces of one block of items; built once per task."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, min_words: int):
        import ahocorasick

        self.items: list[tuple[int | None, list[str], int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text or "")
            if len(words) < min_words:
                continue
            budget = int(rate * len(words))
            for p in range(budget + 1):
                start, end = len(words) * p // (budget + 1), len(words) * (p + 1) // (budget + 1)
                pieces.setdefault(f" {' '.join(words[start:end])} ", []).append((len(self.items), start))
            self.items.append((item_id, words, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> dict[int | None, tuple[int, int, int]]:
        """item_id -> (edits, words of the item, word place in the text where it ends)."""
        if not text or not self.items:
            return {}
        words = words_of(text)
        line = f" {' '.join(words)} "
        starts: list[int] = []
        tried: set[tuple[int, int]] = set()
        found: dict[int | None, tuple[int, int, int]] = {}
        for end, (size, owners) in self.automaton.iter(line):
            if not starts:
                place = 1
                for w in words:
                    starts.append(place)
                    place += len(w) + 1
            at = bisect_left(starts, end - size + 2)
            for index, offset in owners:
                item_id, item, budget = self.items[index]
                low = at - offset
                if (index, low) in tried:
                    continue
                tried.add((index, low))
                low = max(0, low - budget)
                edits, stop = distance(item, words[low : at - offset + len(item) + budget])
                if edits <= budget:
                    match = (edits, len(item), low + stop)
                    found[item_id] = min(found.get(item_id, match), match)
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> list[Broadcast]:
    """Distinct items, at most about ``size`` at a time; the driver holds one block while it sends it."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    rows = materialise(rows, "items")
    parts = max(1, -(-rows.count() // size))
    context, sent = items.sparkSession.sparkContext, []
    for part in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        sent.append(context.broadcast(sorted(map(tuple, block.collect()), key=repr)))
    return sent


def gathered(batches: Iterator[pa.RecordBatch], size: int = TEXT_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Slices of documents, about ``size`` bytes at a time."""
    held, total = [], 0
    for batch in slices(batches):
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def finders(blocks: list[Broadcast], rate: float, min_words: int) -> Callable[[], Iterator[Finder]]:
    """The blocks' automata, one after the other; a single one is built once per task."""
    kept: list[Finder] = []

    def each() -> Iterator[Finder]:
        if kept:
            yield from kept
            return
        for block in blocks:
            finder = Finder(block.value, rate, min_words)
            if len(blocks) == 1:
                kept.append(finder)
            yield finder

    return each


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = RATE,
    min_words: int = 1,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(doc_id, item_id, edits, item_words, end_word): every item within its budget in a document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body"))
    names = ["doc_id", "item_id", "edits", "item_words", "end_word"]
    blocks = item_blocks(items, item_col, item_text_col, block_items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = finders(blocks, rate, min_words)
        for held in gathered(batches):
            for finder in each():
                for batch in held:
                    rows = [
                        (doc_id, item_id, *match)
                        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for item_id, match in finder.find(text).items()
                    ]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    return in_arrow(source, work, ", ".join(f"{n} long" for n in names))


def drop_contaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = RATE,
    min_words: int = EVIDENCE_WORDS,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """The documents in which no item of at least ``min_words`` words occurs; all columns stay."""
    blocks = item_blocks(items, item_col, item_text_col, block_items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = finders(blocks, rate, min_words)
        for held in gathered(batches):
            for finder in each():
                for at, batch in enumerate(held):
                    texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                    held[at] = batch.filter(pa.array([not finder.find(t) for t in texts], pa.bool_()))
            yield from held

    return in_arrow(docs, work, docs.schema)
