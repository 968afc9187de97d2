"""Near-duplicate classes from SimHash fingerprints.

A byte-position inverted index finds the pairs: two fingerprints of ``n`` bytes
that differ in at most ``d`` bits agree in at least ``n - d`` byte positions.
Positions are dealt into groups of four, and a posting is keyed by three
positions of one group with their bytes; with 8 bytes and 3 differing bits, 5
equal positions in two groups always fill three of one group, so every linked
pair meets in a posting.  (A posting per single byte would hold a 256th of all
fingerprints and pair them with the square of the input.)  For a pair that meets,
the shared positional bytes are tallied, pairs below the minimum are left, and
the rest is verified by the number of differing bits.

Defined cases: a null or empty text, or one of white space only, has
fingerprint zero and links like any other.  Rows of one ``doc_id`` are one
document: its texts' classes join.  A row without ``doc_id`` takes the class of
its fingerprint and lends no name to it.  Other columns of the input are never
read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fixed_binary, in_arrow, per_group, slices, word_pieces
from strandline.operators.skew import lookup_join, spread_join
from strandline.session import materialise

SEED = 42
HASH_CHUNK = 16_384  # shingle hashes of 64 bits unpacked to bits at a time
SMALL_RUN = 32
BLOCK = 4_096  # fingerprints of a posting that are compared in one piece
GROUP = 4
POSTINGS = 1 << 18  # postings made at a time
TASK_EDGES = 1 << 20  # edges that a task holds before it turns them into stars

_GOLDEN = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


# fingerprints -------------------------------------------------------------------


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words; one run if there are fewer words."""
    carry: list[bytes] = []
    parts, seen = [], 0
    for words in word_pieces(text.lower()):
        seen += len(words)
        words = carry + words
        carry = words[max(0, len(words) - width + 1) :] if width > 1 else []
        if len(words) >= width:
            runs = map(b" ".join, zip(*[words[i:] for i in range(width)]))
            parts.append(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64))
        else:
            carry = words
    if 0 < seen < width:
        parts.append(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` 64-bit hashes from each one; the first is the hash itself."""
    steps = np.array([_GOLDEN * j % (1 << 64) for j in range(words)], np.uint64)
    out = hashes[:, None] + steps
    out = (out ^ (out >> np.uint64(30))) * _MIX[0]
    out = (out ^ (out >> np.uint64(27))) * _MIX[1]
    out ^= out >> np.uint64(31)
    out[:, 0] = hashes
    return out


def majority_bits(groups: list[np.ndarray], words: int) -> np.ndarray:
    """Per group of hashes, the bits set in over half of them, as bytes."""
    sizes = np.array([len(g) for g in groups], np.int64)
    ones = np.zeros((len(groups), 64 * words), np.int64)
    hashes = np.concatenate(groups) if groups else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(groups)), sizes)
    # runs short enough to be added up in bytes, where hashes are wide
    step, count = (255, np.uint8) if words > 1 else (HASH_CHUNK, np.uint32)
    for start in range(0, len(hashes), step):
        part = widen(hashes[start : start + step], words).astype(">u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)
        mine = owner[start : start + step]
        edges = np.flatnonzero(np.diff(mine, prepend=-1))
        for at, end in zip(edges, [*edges[1:], len(mine)]):
            ones[mine[at]] += bits[at:end].sum(axis=0, dtype=count)
    return np.packbits(ones * 2 > sizes[:, None], axis=1)


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    words: int = 1,
    distinct: bool = False,
) -> DataFrame:
    """``doc_id`` and the binary fingerprint ``fp`` of every row, ``8 * words`` bytes.

    ``distinct`` counts equal shingles of a text once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            groups = [shingle_hashes(t, width) if t else np.empty(0, np.uint64) for t in texts]
            if distinct:
                groups = [np.unique(g) for g in groups]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), fixed_binary(majority_bits(groups, words))], names=["doc_id", "fp"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return in_arrow(source, work, "doc_id long, fp binary")


# links ----------------------------------------------------------------------------


def posting_positions(width: int) -> list[tuple[int, ...]]:
    """Byte positions that key a posting: every three of each group of four."""
    out = []
    for first in range(0, width, GROUP):
        group = range(first, min(first + GROUP, width))
        out += [tuple(p for p in group if p != left) for left in group]
    return out


def postings(points: DataFrame, width: int, kept: tuple[int, ...]) -> DataFrame:
    """(key, node, fp): one row per fingerprint and keyed positions; ``fp`` has the ``kept`` bytes."""
    places, kept = posting_positions(width), list(kept)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, POSTINGS // len(places))):
            nodes = batch.column(0).to_numpy()
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
            wide = data.astype(np.int64)
            keys = np.stack(
                [(at << 24) + (wide[:, p] << 16) + (wide[:, q] << 8) + wide[:, r] for at, (p, q, r) in enumerate(places)],
                axis=1,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel()),
                    pa.array(np.repeat(nodes, len(places))),
                    fixed_binary(np.repeat(data[:, kept], len(places), axis=0)),
                ],
                names=["key", "node", "fp"],
            )

    return in_arrow(points.select("node", "fp"), work, "key long, node long, fp binary")


def spanning_tree(size: int, hits: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all linked rows of one block, fewer than its rows.

    ``hits(at, others)`` tells which of ``others`` row ``at`` links to; rows
    already reached are not asked again.
    """
    heads, tails = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    left, frontier = np.arange(size), []
    while len(left):
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
            continue
        at = frontier.pop()
        hit = hits(at, left)
        if hit.any():
            heads.append(np.full(hit.sum(), at))
            tails.append(left[hit])
            frontier += left[hit].tolist()
            left = left[~hit]
    return np.concatenate(heads), np.concatenate(tails)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) rows that join what edges (a, b) join: one for every node but the smallest of its group."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        # labels are nodes: what hangs on a node goes where that node went
        np.minimum.at(label, before, label)
        label = label[label]
        if np.array_equal(label, before):
            break
    member = np.flatnonzero(label != np.arange(len(names)))
    return names[label[member]], names[member]


class Gathered:
    """The edges of one task, as stars over all that it has seen; what outgrows its limit leaves early."""

    def __init__(self, limit: int = TASK_EDGES):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.parts.append((a, b))
        self.size += len(a)
        if self.size > self.limit:
            root, member = stars(*map(np.concatenate, zip(*self.parts)))
            self.parts, self.size = [(root, member)], len(root)
            if self.size > self.limit // 2:
                yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size:
            yield stars(*map(np.concatenate, zip(*self.parts)))
        self.parts, self.size = [], 0


class Linker:
    """Compares the fingerprints of one posting; runs inside tasks."""

    def __init__(self, max_bits: int, min_shared: int):
        self.max_bits, self.min_shared = max_bits, min_shared

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row by row (or broadcast): enough shared positional bytes, few enough differing bits."""
        near = (a == b).sum(axis=-1) >= self.min_shared
        if near.any():
            x, y = np.broadcast_arrays(a, b)
            x, y = np.ascontiguousarray(x[near]).view(np.uint64), np.ascontiguousarray(y[near]).view(np.uint64)
            near[near] = np.bitwise_count(x ^ y).sum(axis=-1) <= self.max_bits
        return near

    def tree(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return spanning_tree(len(data), lambda at, others: self.linked(data[others], data[at]))

    def forest(self, keys: np.ndarray, nodes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(root, member) rows that join what is linked within each run of equal keys."""
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        sizes = np.diff(starts, append=len(keys))
        heads, tails = [], []
        size_of = np.repeat(sizes, sizes)
        small = np.flatnonzero((size_of > 1) & (size_of <= SMALL_RUN))
        if len(small):
            k, d = keys[small], data[small]
            for step in range(1, int(size_of[small].max())):
                at = np.flatnonzero(k[step:] == k[:-step])
                at = at[self.linked(d[at], d[at + step])]
                heads.append(small[at])
                tails.append(small[at + step])
        for start, size in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN]):
            a, b = self.tree(data[start : start + size])
            heads.append(a + start)
            tails.append(b + start)
        if not heads:
            return nodes[:0], nodes[:0]
        return stars(nodes[np.concatenate(heads)], nodes[np.concatenate(tails)])


_OUT = "a long, b long, key long, fp binary"


def _edge_rows(root: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
    n = len(root)
    return pa.RecordBatch.from_arrays(
        [pa.array(root), pa.array(member), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["a", "b", "key", "fp"]
    )


def _long_rows(keys: np.ndarray, nodes: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(keys), fixed_binary(data)], names=["a", "b", "key", "fp"]
    )


def dealt_blocks(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows of each key dealt to pairs (i, j) of blocks, so that any two rows meet in one pair.

    Blocks are made by a hash of ``node`` and hold about half of ``block`` rows.
    """
    sizes = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "block-sizes")
    parts = F.ceil(F.col("n") * 2 / F.lit(block)).cast("long")
    parts = sizes.select(*keys, F.when(parts <= 2, 1).otherwise(parts).alias("parts"))
    return (
        spread_join(rows, parts, keys, rows=block, counts=sizes)
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})
        .drop("parts", "mine", "other")
    )


def links(
    points: DataFrame,
    width: int,
    max_bits: int,
    min_shared: int,
    block: int = BLOCK,
    kept: tuple[int, ...] | None = None,
) -> DataFrame:
    """Edges (a, b) that connect exactly the linked fingerprints of ``points`` (node, fp).

    The tally and the differing bits are taken over the ``kept`` byte positions, all unless given.

    A task walks the postings in key order and holds at most one of them and one
    batch.  A posting of more than ``block`` fingerprints is passed on row by
    row; it is then compared block by block, each pair of blocks in a task of
    its own.  Instead of all pairs, each task returns stars that connect the
    same nodes: at most one edge for a node, though copies meet in hundreds of
    postings.  Edges of different tasks are then dealt by their larger node and
    turned into stars once more.
    """
    kept = tuple(range(width)) if kept is None else kept
    stride = len(kept)
    linker = Linker(max_bits, min_shared)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing, gathered = None, None, Gathered()
        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, stride)
            if passing is not None:
                cut = int(np.searchsorted(keys, passing, "right"))
                if cut:
                    yield _long_rows(keys[:cut], nodes[:cut], data[:cut])
                keys, nodes, data = keys[cut:], nodes[cut:], data[cut:]
                if not len(keys):
                    continue
                passing = None
            if held is not None:
                keys, nodes, data = (np.concatenate(x) for x in zip(held, (keys, nodes, data)))
            last = int(np.searchsorted(keys, keys[-1], "left"))
            yield from whole(keys[:last], nodes[:last], data[:last], gathered)
            held = keys[last:], nodes[last:], data[last:]
            if len(held[0]) > block:
                yield _long_rows(*held)
                passing, held = held[0][0], None
        if held is not None:
            yield from whole(*held, gathered)
        for root, member in gathered.rest():
            yield _edge_rows(root, member)

    def whole(keys, nodes, data, gathered: Gathered) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        sizes = np.diff(starts, append=len(keys))
        long = np.repeat(sizes > block, sizes)
        if long.any():
            yield _long_rows(keys[long], nodes[long], data[long])
        several = np.repeat((sizes > 1) & (sizes <= block), sizes)
        if several.any():
            for root, member in gathered.add(*linker.forest(keys[several], nodes[several], data[several])):
                yield _edge_rows(root, member)

    index = postings(points, width, kept).repartition("key").sortWithinPartitions("key", "node")
    found = materialise(in_arrow(index, walk, _OUT), "simhash-links")
    edges = found.where(F.col("key").isNull()).select("a", "b")
    long = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("node"), "fp")
    if long.isEmpty():
        return as_stars(edges)

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        data = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(-1, stride)
        a, b = linker.tree(data)
        return pa.table({"a": np.minimum(nodes[a], nodes[b]), "b": np.maximum(nodes[a], nodes[b])})

    blocks = per_group(dealt_blocks(long, ["key"], block), ["key", "i", "j"], compare, "a long, b long")
    return as_stars(edges.unionByName(blocks))


def as_stars(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes, where many tasks found the same groups.

    Dealt by the larger node, a part has some members of a group and all its
    roots, so of each group little more than one edge a member is left.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered()
        row = lambda pair: pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])
        for batch in batches:
            yield from map(row, gathered.add(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        yield from map(row, gathered.rest())

    dealt = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition("b")
    return in_arrow(dealt, work, "a long, b long").distinct()


# classes ---------------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node reaches, for nodes with an edge.

    Every round hangs the larger neighbours of a node, then its smaller ones, on
    the smallest node around it; a few rounds turn any graph into stars.  Each
    round is written to the shared folder.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())

    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    state = mark(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        before, state = state, mark(e)
        if before == state:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(
    prints: DataFrame,
    words: int = 1,
    max_bits: int = 3,
    min_shared: int | None = None,
    block: int = BLOCK,
    kept: tuple[int, ...] | None = None,
) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``prints``.

    ``min_shared`` is the least number of equal byte positions of a linked pair;
    unless given, the number that ``max_bits`` guarantees.  With ``8 - max_bits``
    of 8 positions at least 5, every link is found.  Wider fingerprints with more
    differing bits are found with the probability that three bytes of some group
    are equal.  Equal fingerprints collapse before anything is compared, so the
    size of a group of copies costs nothing.
    """
    width = 8 * words
    if min_shared is None:
        min_shared = width - max_bits
        if words > 1 or min_shared < 5:
            raise ValueError("no number of shared bytes is guaranteed; give min_shared")
    prints = materialise(prints.select("doc_id", "fp"), "fingerprints")
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "points")
    known = points.where(F.col("node").isNotNull())
    roots = connected(links(known, width, max_bits, min_shared, block, kept))
    named = points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# near copies by similarity -----------------------------------------------------------

WIDE_WORDS = 64
WIDE_KEPT = tuple(range(0, 8 * WIDE_WORDS, 32))
WIDE_BITS = 35  # of the 128 kept bits; at a similarity of 0.8 about 19 differ, with a deviation of 4
EXACT_BLOCK = 2_048


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    width: int = 5,
    block: int = BLOCK,
    exact_block: int = EXACT_BLOCK,
) -> DataFrame:
    """``doc_id`` and ``class_id`` (smallest id of its class) of every row.

    Two texts link when the Jaccard similarity of their distinct ``width``-word
    shingles is at least ``similarity``.  Fingerprints of 4,096 bits over 3-word
    shingles and the byte index give candidate classes.  A passage that is added,
    dropped or replaced leaves the 3-word similarity at that of the 5-word one: at
    0.8, 15 % of the bits differ, two texts share three bytes of one group with a
    probability of 0.062, and all 128 groups and the bit limit miss about one pair
    in 3,000; scattered edits and higher similarities miss fewer.  Within a
    candidate class the sets of shingle hashes are compared exactly, block by
    block.  Equal fingerprints are taken as copies.  Of the 16 kept bytes, 35
    differing bits may spoil every one, so the guaranteed number of equal bytes is
    none: the count filter is the meeting in a posting (three equal bytes of four)
    alone, and the kept bits decide.
    """
    prints = fingerprints(docs, id_col, text_col, 3, WIDE_WORDS, distinct=True)
    least = max(0, len(WIDE_KEPT) - WIDE_BITS)
    found = materialise(classes(prints, WIDE_WORDS, WIDE_BITS, least, block, WIDE_KEPT), "candidates")
    mixed = (
        found.where(F.col("component_id").isNotNull())
        .groupBy("component_id")
        .agg((F.min("fp") != F.max("fp")).alias("mixed"))
        .where("mixed")
        .select("component_id")
    )
    members = lookup_join(found, materialise(mixed, "mixed"), ["component_id"], "left_semi")
    members = materialise(members.select("doc_id", "component_id").distinct(), "members")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t or b"", width)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "component_id", "grams"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    texts = lookup_join(texts, members, ["doc_id"], "inner").select("doc_id", "component_id", "body")
    sets = materialise(
        in_arrow(texts, grams, "doc_id long, component_id long, grams binary").withColumn("sig", F.xxhash64("grams")), "grams"
    )
    nodes = sets.groupBy("component_id", "sig").agg(F.min("doc_id").alias("node"), F.first("grams").alias("grams"))

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        held = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
        sizes = np.array([len(g) for g in held])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(held)

        def hits(at: int, others: np.ndarray) -> np.ndarray:
            out = np.zeros(len(others), bool)
            low, high = sizes[at] * similarity, sizes[at] / similarity
            able = np.flatnonzero((sizes[others] >= low) & (sizes[others] <= high))
            for i in able:
                other = others[i]
                both = len(np.intersect1d(held[at], flat[ends[other] : ends[other + 1]], assume_unique=True))
                out[i] = both >= similarity * (sizes[at] + sizes[other] - both)
            return out

        a, b = spanning_tree(len(nodes), hits)
        return pa.table({"a": np.minimum(nodes[a], nodes[b]), "b": np.maximum(nodes[a], nodes[b])})

    edges = per_group(dealt_blocks(nodes, ["component_id"], exact_block), ["component_id", "i", "j"], compare, "a long, b long")
    roots = connected(edges)
    class_of = materialise(nodes.select("component_id", "sig", "node").join(roots, "node", "left"), "exact-classes")
    named = (
        lookup_join(sets.select("doc_id", "component_id", "sig"), class_of, ["component_id", "sig"], "inner")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("root", "node")).alias("exact_id"))
    )
    return found.join(named, "doc_id", "left").select("doc_id", F.coalesce("exact_id", "component_id").alias("class_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their class; all columns stay.

    Rows without an id stay, and so do all rows of one id, which are one document.
    """
    found = near_copies(docs, id_col, text_col, **options)
    gone = materialise(found.where("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct(), "copies")
    return lookup_join(docs, gone, [id_col], "left_anti")
