"""Boosted trees that always split the leaf with the largest gain.

Spark ML grows all leaves of a level; here the number of leaves is the limit, as
in settings that name leaves.  Values are cut into bins once.  A pass over the
rows adds up gradient, curvature and rows per leaf, place and bin, the best cut of
every leaf is found from these sums in Spark, and only that cut reaches the driver.
A pass serves all leaves that may still be split, so a tree takes about as many
passes as it is deep, not one per leaf (``grow``).

A whole fit takes hundreds of trees, and a job for each pass would cost more than
its sums.  There the rows are dealt once to tasks that run together (barrier
mode).  Each task keeps the cells of its rows, adds them up per leaf, place and
bin, and hands only these sums to the others; all tasks take the same cut from the
same totals.  What is exchanged is as wide as the bins, however many rows there are;
Spark answers an exchange after a second, so few tasks with many rows each take part.

Zeros are not stored: what a leaf has beyond its stored cells lies in the bin of
zero.  A null vector or outcome stops the fit.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialise, ship

LEAST_CURVATURE = 1e-3  # of a leaf
JOB_TREES = 200  # grown by one job; a lost executor costs at most so many
TASK_ROWS = 250_000  # of a task of a fit, or more where slots are few; an exchange between tasks takes a second


@dataclass(frozen=True)
class Settings:
    """``row_share`` and ``place_share`` of rows and places are drawn anew for each tree, by hash."""

    leaves: int = 15
    least_rows: int = 100
    rate: float = 0.05
    penalty: float = 0.0
    row_share: float = 1.0
    place_share: float = 1.0
    bins: int = 127
    rounds: int = 1600
    patience: int = 75


# Leaves, least rows of a leaf, step, squared penalty, shares of rows and places.
GRID = (
    Settings(15, 100, 0.05, 5.0, 0.8, 1.0),
    Settings(31, 100, 0.05, 1.0, 0.8, 0.8),
    Settings(63, 200, 0.03, 5.0, 0.8, 0.8),
)


@dataclass(frozen=True)
class Sums:
    n: int
    g: float
    h: float

    def minus(self, other: Sums) -> Sums:
        return Sums(self.n - other.n, self.g - other.g, self.h - other.h)


@dataclass(frozen=True)
class Cut:
    """Rows whose bin at ``place`` is at most ``upto`` go left."""

    place: int
    upto: int
    zero: int
    gain: float
    left: Sums


@dataclass(frozen=True)
class Tree:
    """Nodes are numbered from 1; node k has the children 2k and 2k + 1."""

    cuts: dict[int, Cut]
    leaves: dict[int, Sums]
    order: tuple[int, ...]

    def values(self, settings: Settings) -> dict[int, float]:
        return {k: -settings.rate * s.g / (s.h + settings.penalty) for k, s in self.leaves.items()}


@dataclass
class Forest:
    start: float
    edges: DataFrame
    settings: Settings
    trees: list[Tree]
    losses: list[float]


# bins -------------------------------------------------------------------------

def bin_edges(rows: DataFrame, features: str, bins: int) -> DataFrame:
    """(place, edges, zero): quantiles of the stored values of a place, and zero.

    ``percentile_approx`` merges sketches, so no place's values come together.
    """
    shares = [i / (bins - 1) for i in range(bins - 1)]
    edges = F.array_sort(F.array_distinct(F.concat(F.percentile_approx("x", shares, 10_000), F.array(F.lit(0.0)))))
    found = _stored(rows, features).groupBy("place").agg(edges.alias("edges"))
    return found.withColumn("zero", F.array_position("edges", F.lit(0.0)).cast("int") - 1)


def _stored(rows: DataFrame, features: str, *keep: str) -> DataFrame:
    """One row per stored value that is not zero."""
    vector = F.unwrap_udt(features)
    cells = rows.select(*keep, vector["indices"].alias("_at"), F.posexplode(vector["values"]).alias("_k", "x"))
    place = F.coalesce(F.get("_at", F.col("_k")), F.col("_k")).alias("place")
    # adding zero turns a negative zero into zero
    return cells.where(F.col("x") != 0).select(*keep, place, (F.col("x") + F.lit(0.0)).alias("x"))


def binned(rows: DataFrame, features: str, edges: DataFrame) -> DataFrame:
    """Add ``cells``, an array of (place, bin, zero), where zero is the bin of zero.  The edges are part of the model and as wide as it.

    They travel as one value, so the rows keep their place and are not shuffled.
    """
    table = edges.agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("edges", "zero")))).alias("_edges"))
    vector = F.unwrap_udt(features)
    at = lambda k: F.coalesce(F.get(vector["indices"], k), k)
    values = F.transform(vector["values"], lambda x, k: F.struct(at(k).alias("place"), (x + F.lit(0.0)).alias("x")))
    known = F.filter(values, lambda c: (c["x"] != 0) & F.map_contains_key("_edges", c["place"]))
    number = lambda c: F.size(F.filter(F.col("_edges")[c["place"]]["edges"], lambda e: e < c["x"]))
    zero = lambda c: F.col("_edges")[c["place"]]["zero"]
    cells = F.transform(known, lambda c: F.struct(c["place"].alias("place"), number(c).alias("bin"), zero(c).alias("zero")))
    return rows.withColumn("_edges", table.scalar()).withColumn("cells", cells).drop("_edges")


# one tree ---------------------------------------------------------------------

def best_cuts(rows: DataFrame, totals: dict[int, Sums], settings: Settings, number: int = 0) -> dict[int, Cut]:
    """The cut with the largest gain of each node; ``rows`` has node, g, h and cells.

    Nodes without a cut that leaves enough rows on both sides are not in the result.
    At equal gains the lower place, then the lower bin, is taken.  ``number`` is the
    tree whose places are drawn.
    """
    cells = rows.select("node", "g", "h", F.inline("cells"))
    sums = drawn(cells, settings.place_share, number, "place").groupBy("node", "place", "zero", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")
    )
    for c in "ngh":
        pairs = [x for k, s in totals.items() for x in (F.lit(k).cast("long"), F.lit(getattr(s, c)))]
        sums = sums.withColumn(f"{c}_all", F.create_map(*pairs)[F.col("node")])
    group = Window.partitionBy("node", "place")
    ordered = group.orderBy("bin")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    sides = sums.select(
        "*", F.lag("bin", 1, -1).over(ordered).alias("before"),
        *[F.sum(c).over(upto).alias(f"{c}_upto") for c in "ngh"],
        *[(F.col(f"{c}_all") - F.sum(c).over(group)).alias(f"{c}_zero") for c in "ngh"],
    )
    inside = F.when(F.col("zero") <= F.col("bin"), 1).otherwise(0)
    here = F.struct(F.col("bin").alias("upto"), *[(F.col(f"{c}_upto") + inside * F.col(f"{c}_zero")).alias(f"{c}_left") for c in "ngh"])
    # zeros alone may end a side, in a bin that has no stored value
    gap = F.struct(F.col("zero").alias("upto"), *[(F.col(f"{c}_upto") - F.col(c) + F.col(f"{c}_zero")).alias(f"{c}_left") for c in "ngh"])
    between = (F.col("before") < F.col("zero")) & (F.col("zero") < F.col("bin"))
    options = F.when(between, F.array(gap, here)).otherwise(F.array(here))
    cuts = sides.select("node", "place", "zero", "n_all", "g_all", "h_all", F.inline(options))
    right = {c: F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ngh"}
    part = lambda g, h: g * g / (h + settings.penalty)
    gain = part(F.col("g_left"), F.col("h_left")) + part(right["g"], right["h"]) - part(F.col("g_all"), F.col("h_all"))
    allowed = (F.least("n_left", right["n"]) >= settings.least_rows) & (F.least("h_left", right["h"]) >= LEAST_CURVATURE)
    cuts = cuts.where(allowed).withColumn("gain", gain).where("gain > 1e-9")
    first = F.struct(F.round("gain", 9), -F.col("place"), -F.col("upto"))
    best = cuts.groupBy("node").agg(F.max_by(F.struct("place", "upto", "zero", "gain", "n_left", "g_left", "h_left"), first).alias("c"))
    return {
        r["node"]: Cut(r["place"], r["upto"], r["zero"], r["gain"], Sums(r["n_left"], r["g_left"], r["h_left"]))
        for r in best.select("node", "c.*").collect()
    }


def node_of(cuts: dict[int, Cut], node: int = 1) -> Column:
    """The node that a row with ``cells`` falls into."""
    if node not in cuts:
        return F.lit(node).cast("long")
    cut = cuts[node]
    found = F.get(F.filter("cells", lambda c: c["place"] == cut.place), 0)["bin"]
    return F.when(F.coalesce(found, F.lit(cut.zero)) <= cut.upto, node_of(cuts, 2 * node)).otherwise(node_of(cuts, 2 * node + 1))


def grow(rows: DataFrame, settings: Settings, number: int = 0) -> Tree:
    """One tree from rows with g, h and cells: the leaf with the largest gain is split next."""
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).first()
    if not facts["n"]:
        raise ValueError("no rows to grow a tree from")
    sums = {1: Sums(facts["n"], facts["g"], facts["h"])}
    known = best_cuts(rows.withColumn("node", F.lit(1).cast("long")), sums, settings, number)
    seen, leaves, cuts, order = {1}, {1}, {}, []
    while len(leaves) < settings.leaves:
        open_leaves = [k for k in leaves if k in known]
        if not open_leaves:
            break
        node = max(open_leaves, key=lambda k: (round(known[k].gain, 9), -k))
        if 2 * node not in seen:
            # one pass for the children of every leaf that could be split next
            ready = sorted(open_leaves, key=lambda k: -known[k].gain)[: settings.leaves - len(leaves)]
            children = {c for k in {node, *ready} if 2 * k not in seen for c in (2 * k, 2 * k + 1)}
            for child in children:
                cut, whole = known[child // 2], sums[child // 2]
                sums[child] = whole.minus(cut.left) if child % 2 else cut.left
            below = {k: known[k] for k in seen if 2 * k in seen or 2 * k in children}
            placed = rows.withColumn("node", node_of(below)).where(F.col("node").isin(sorted(children)))
            known |= best_cuts(placed, {c: sums[c] for c in children}, settings, number)
            seen |= children
        cuts[node] = known[node]
        order.append(node)
        leaves = (leaves - {node}) | {2 * node, 2 * node + 1}
    return Tree(cuts, {k: sums[k] for k in leaves}, tuple(order))


# the sum of trees -------------------------------------------------------------

def with_slopes(rows: DataFrame, y: str, f: str = "f") -> DataFrame:
    """Gradient and curvature of the log loss at the present score."""
    p = 1 / (1 + F.exp(-F.col(f)))
    return rows.withColumns({"g": p - F.col(y), "h": p * (1 - p)})


def starting_score(rows: DataFrame, y: str) -> float:
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.count(y).alias("known")).first()
    if facts["known"] != facts["n"] or not facts["n"] or not 0 < facts["s"] < facts["n"]:
        raise ValueError("outcomes must be known and of both kinds")
    return math.log(facts["s"] / (facts["n"] - facts["s"]))


def drawn(rows: DataFrame, share: float, number: int, column: str) -> DataFrame:
    """The rows whose key is drawn for a tree; a recomputed task draws the same."""
    if share >= 1.0:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(number), F.col(column)), F.lit(1_000_000)) < int(share * 1_000_000))


# trees from rows that stay in their tasks ---------------------------------------

@dataclass(frozen=True)
class Places:
    """Bins of all places side by side: those of the k-th begin at ``first[k]``."""

    number: np.ndarray
    zero: np.ndarray
    first: np.ndarray

    @property
    def whose(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.number)), np.diff(self.first))

    def running(self, stored: np.ndarray) -> np.ndarray:
        """Sums up to each bin, inside its place; places with equally many bins are summed together."""
        out, widths = np.empty_like(stored), np.diff(self.first)
        for width in np.unique(widths):
            at = self.first[:-1][widths == width][:, None] + np.arange(width)
            out[at] = np.cumsum(stored[at], axis=1)
        return out


def _places(edges: DataFrame) -> Places:
    """One row per place; the edges themselves stay a table."""
    found = sorted((r["place"], r["zero"], r["n"]) for r in edges.select("place", "zero", F.size("edges").alias("n")).collect())
    column = lambda k: np.array([f[k] for f in found], np.int64)
    return Places(column(0), column(1), np.concatenate([[0], np.cumsum(column(2) + 1)]).astype(np.int64))


class Part:
    """Stored cells of some rows, by row to add them up and by place to split the rows."""

    def __init__(self, places: Places, at: pa.Array, bins: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.places, self.rows = places, len(lengths)
        self.begins = np.concatenate([[0], np.cumsum(lengths)])
        place = np.searchsorted(places.number, at.flatten().to_numpy(zero_copy_only=False))
        number = bins.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        self.cells = (places.first[place] + number).astype(np.int32)
        order = np.argsort(place, kind="stable")
        self.row = np.repeat(np.arange(self.rows, dtype=np.int32), lengths)[order]
        self.bin = number[order]
        self.spans = np.searchsorted(place[order], np.arange(len(places.number) + 1))

    def sums(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        """Rows, gradient and curvature of the stored cells of ``rows`` per bin."""
        begins = self.begins[rows]
        lengths = self.begins[rows + 1] - begins
        ends = np.cumsum(lengths)
        cells = self.cells[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lengths, lengths)]
        width = int(self.places.first[-1])
        weighted = [np.bincount(cells, np.repeat(v[rows], lengths), width).astype(float) for v in (g, h)]
        return [np.bincount(cells, minlength=width), *weighted]

    def move(self, slots: np.ndarray, slot: int, cut: Cut, right: int) -> None:
        """Rows of ``slot`` that the cut sends right go to the slot ``right``."""
        k = int(np.searchsorted(self.places.number, cut.place))
        stored, above = self.row[self.spans[k] : self.spans[k + 1]], self.bin[self.spans[k] : self.spans[k + 1]] > cut.upto
        here = slots == slot
        if cut.zero <= cut.upto:
            there = stored[above]
            slots[there[here[there]]] = right
        else:
            here[stored[~above]] = False
            slots[here] = right

    def added(self, tree: Tree, settings: Settings) -> np.ndarray:
        """The value of the leaf that each row falls into."""
        slots, of = np.zeros(self.rows, np.int32), {1: 0}
        for right, node in enumerate(tree.order, 1):
            self.move(slots, of[node], tree.cuts[node], right)
            of |= {2 * node: of.pop(node), 2 * node + 1: right}
        values = tree.values(settings)
        return np.array([values[k] for k, _ in sorted(of.items(), key=lambda x: x[1])])[slots]


def _totals(context: BarrierTaskContext | None, n: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Sums over all tasks, added in the same order in each of them."""
    if context is None:
        return [n, g, h]
    at = np.flatnonzero(n)
    packed = np.concatenate([[len(at)], at, n[at]]).astype("<i8").tobytes() + np.concatenate([g[at], h[at]]).astype("<f8").tobytes()
    total = [np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))]
    for text in context.allGather(base64.b64encode(packed).decode()):
        whole, parts = np.frombuffer(base64.b64decode(text), "<i8"), np.frombuffer(base64.b64decode(text), "<f8")
        size = int(whole[0])
        at = whole[1 : size + 1]
        total[0][at] += whole[size + 1 : 2 * size + 1]
        total[1][at] += parts[2 * size + 1 : 3 * size + 1]
        total[2][at] += parts[3 * size + 1 :]
    return total


def _hash(values: np.ndarray, seed: np.ndarray | int, long: bool) -> np.ndarray:
    """Spark's ``xxhash64`` of ints or longs, for a seed or the hash of the column before."""
    u = np.uint64
    p1, p2, p3, p4, p5 = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    with np.errstate(over="ignore"):
        start = np.asarray(seed).astype(u) + p5
        if long:
            h = (start + u(8)) ^ (turned(values.astype(u) * p2, 31) * p1)
            h = turned(h, 27) * p1 + p4
        else:
            h = (start + u(4)) ^ ((values.astype(u) & u(0xFFFFFFFF)) * p1)
            h = turned(h, 23) * p2 + p3
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
    return h ^ (h >> u(32))


def drawn_values(values: np.ndarray, share: float, number: int, long: bool) -> np.ndarray:
    """Which of the values ``drawn`` keeps for a tree."""
    if share >= 1.0:
        return np.ones(len(values), bool)
    bits = _hash(values, _hash(np.array([number]), 42, False), long).astype(np.int64)
    return np.mod(bits, 1_000_000) < int(share * 1_000_000)


def _best_cut(places: Places, sums: list[np.ndarray], whole: Sums, settings: Settings, allowed: np.ndarray) -> Cut | None:
    """The cut with the largest gain of a leaf, with the ties of ``best_cuts``."""
    first, whose = places.first, places.whose
    left = []
    for stored, total in zip(sums, (whole.n, whole.g, whole.h)):
        upto = places.running(stored)
        # zeros lie in their bin, beyond what is stored there
        inside = np.arange(len(whose)) - first[:-1][whose] >= places.zero[whose]
        left.append(upto + inside * (total - upto[first[1:] - 1])[whose])
    n, g, h = left
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda g, h: g * g / (h + settings.penalty)
        gain = part(g, h) + part(whole.g - g, whole.h - h) - part(whole.g, whole.h)
    fits = (np.minimum(n, whole.n - n) >= settings.least_rows) & (np.minimum(h, whole.h - h) >= LEAST_CURVATURE) & (gain > 1e-9)
    fits &= allowed[whose]
    if not fits.any():
        return None
    at = int(np.argmax(np.where(fits, np.round(gain, 9), -1.0)))
    k = int(whose[at])
    return Cut(int(places.number[k]), int(at - first[k]), int(places.zero[k]), float(gain[at]), Sums(int(n[at]), float(g[at]), float(h[at])))


def _grow_together(part: Part, context: BarrierTaskContext | None, sample: np.ndarray, g: np.ndarray, h: np.ndarray, settings: Settings, number: int) -> Tree:
    """``grow`` over the rows of all tasks; only the smaller side of a cut is added up, the other is what is left."""
    places, width = part.places, int(part.places.first[-1])
    allowed = drawn_values(places.number, settings.place_share, number, False)
    at = np.flatnonzero(sample)
    facts = [np.array([x]) for x in (len(at), g[at].sum(), h[at].sum())]
    found = _totals(context, *[np.concatenate(pair) for pair in zip(facts, part.sums(at, g, h))])
    if not found[0][0]:
        raise ValueError("no rows to grow a tree from")
    whole = {1: Sums(int(found[0][0]), float(found[1][0]), float(found[2][0]))}
    sums = {1: [v[1:] for v in found]}
    known = {1: _best_cut(places, sums[1], whole[1], settings, allowed)}
    slots, of, leaves, cuts, order = np.zeros(part.rows, np.int32), {1: 0}, {1}, {}, []
    while len(leaves) < settings.leaves:
        open_leaves = [k for k in leaves if known[k]]
        if not open_leaves:
            break
        node = max(open_leaves, key=lambda k: (round(known[k].gain, 9), -k))
        if 2 * node not in known and len(leaves) + 1 < settings.leaves:
            # one exchange for the children of every leaf that could be split next
            ready = sorted(open_leaves, key=lambda k: -known[k].gain)[: settings.leaves - len(leaves)]
            fresh = sorted(k for k in {node, *ready} if 2 * k not in known)
            for k in fresh:
                right = len(of) // 2 + 1  # two nodes come for each that is split
                part.move(slots, of[k], known[k], right)
                of |= {2 * k: of[k], 2 * k + 1: right}
                whole |= {2 * k: known[k].left, 2 * k + 1: whole[k].minus(known[k].left)}
            less = [min(2 * k, 2 * k + 1, key=lambda c: whole[c].n) for k in fresh]
            added = [part.sums(np.flatnonzero((slots == of[c]) & sample), g, h) for c in less]
            added = _totals(context, *[np.concatenate(v) for v in zip(*added)])
            for place, c in enumerate(less):
                sums[c] = [v[place * width : (place + 1) * width] for v in added]
                sums[c ^ 1] = [a - b for a, b in zip(sums.pop(c // 2), sums[c])]
                known |= {k: _best_cut(places, sums[k], whole[k], settings, allowed) for k in (c, c ^ 1)}
        cuts[node] = known[node]
        order.append(node)
        whole |= {2 * node: cuts[node].left, 2 * node + 1: whole[node].minus(cuts[node].left)}
        leaves = (leaves - {node}) | {2 * node, 2 * node + 1}
        known |= {c: None for c in (2 * node, 2 * node + 1) if c not in known}  # the last ones
    return Tree(cuts, {k: whole[k] for k in leaves}, tuple(order))


def kept_trees(losses: list[float]) -> int:
    """Trees up to the one with the lowest loss."""
    best, kept = math.inf, 0
    for number, now in enumerate(losses, 1):
        if now < best - 1e-12:
            best, kept = now, number
    return kept


def _grow_trees(batches: Iterator[pa.RecordBatch], settings: Settings, places: Places, start: float, trees: list[Tree], losses: list[float], alone: bool):
    """The next trees over the rows of all tasks; the first task gives them back with the loss of the marked rows."""
    context = None if alone else BarrierTaskContext.get()
    schema = pa.schema([("draw", pa.int64()), ("y", pa.int32()), ("later", pa.bool_()), ("places", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32()))])
    read = list(batches)
    rows = (pa.Table.from_batches(read) if read else schema.empty_table()).combine_chunks()
    column = lambda name: rows[name].combine_chunks()
    part = Part(places, column("places"), column("bins"))
    draw, y, later = (column(c).to_numpy(zero_copy_only=False) for c in ("draw", "y", "later"))
    later = later.astype(bool)
    f = np.full(part.rows, start)
    for tree in trees:
        f += part.added(tree, settings)
    losses, grown = list(losses), []
    while len(losses) < settings.rounds and len(grown) < JOB_TREES and len(losses) - kept_trees(losses) < settings.patience:
        number = len(losses)
        p = 1 / (1 + np.exp(-f))
        sample = ~later & drawn_values(draw, settings.row_share, number, True)
        tree = _grow_together(part, context, sample, p - y, p * (1 - p), settings, number)
        if not tree.cuts:
            break
        f += part.added(tree, settings)
        of, known = f[later], y[later]
        loss = np.log1p(np.exp(-np.abs(of))) + np.maximum(of, 0) - known * of
        n, total, _ = (x[0] for x in _totals(context, np.array([len(of)]), np.array([loss.sum()]), np.zeros(1)))
        losses.append(float(total / n) if n else math.nan)
        grown.append((number, losses[-1], pickle.dumps(tree)))
        if not n:
            break
    if alone or context.partitionId() == 0:
        columns = [pa.array([t[k] for t in grown], kind) for k, kind in enumerate((pa.int32(), pa.float64(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(columns, ["number", "loss", "tree"])


def fit(df: DataFrame, key: str, y: str, is_validation: str, features: str, settings: Settings) -> Forest:
    """Trees until the log loss of the marked rows has not improved for ``patience`` trees.

    Marked rows take no part in bins, sums or leaf values.  The trees up to the best
    one are kept.  A job grows up to ``JOB_TREES`` trees over rows that are dealt once
    to at most as many tasks as can run at the same time, and the next job goes on
    from the trees there are.
    """
    kept = df.select(F.col(key).alias("key"), features, F.col(y).cast("int").alias("y"), F.col(is_validation).alias("later"))
    edges = materialise(bin_edges(kept.where(~F.col("later")), features, settings.bins), "edges")
    if not kept.where("key IS NULL OR y IS NULL OR later IS NULL").isEmpty() or not kept.where(F.col(features).isNull()).isEmpty():
        raise ValueError("a key, outcome, mark or vector is null")
    key_type = dict(kept.dtypes)["key"]
    draw = F.col("key") if key_type == "bigint" else F.xxhash64("key")
    cells = [F.col(f"cells.{c}").alias(f"{c}s") for c in ("place", "bin")]
    rows = materialise(binned(kept, features, edges).select(draw.alias("draw"), "y", "later", *cells), "binned")
    start = starting_score(rows.where("not later"), "y")
    spark = df.sparkSession
    ship(spark)
    parts = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS)))
    dealt, places = rows.select("draw", "y", "later", "places", "bins").repartition(parts), _places(edges)
    trees, losses = [], []
    while len(trees) < settings.rounds and len(trees) - kept_trees(losses) < settings.patience:
        grow_next = partial(_grow_trees, settings=settings, places=places, start=start, trees=trees, losses=losses, alone=parts == 1)
        found = dealt.mapInArrow(grow_next, "number int, loss double, tree binary", barrier=True).collect()
        for r in sorted(found, key=lambda r: r["number"]):
            if math.isnan(r["loss"]):
                raise ValueError("no validation row")
            trees.append(pickle.loads(r["tree"]))
            losses.append(r["loss"])
        if len(found) < JOB_TREES:
            break
    return Forest(start, edges, settings, trees[: kept_trees(losses)], losses)


def score(forest: Forest, df: DataFrame, features: str, out: str = "p") -> DataFrame:
    """Probabilities of all rows; the trees are part of the model and go to the tasks, where all are added in one pass."""
    ship(df.sparkSession)
    places, start, settings, trees = _places(forest.edges), forest.start, forest.settings, forest.trees

    @F.arrow_udf("double")
    def total(at: pa.Array, bins: pa.Array) -> pa.Array:
        part = Part(places, at, bins)
        return pa.array(sum((part.added(tree, settings) for tree in trees), np.full(part.rows, start)), pa.float64())

    rows = binned(df, features, forest.edges).withColumn("_f", total(F.col("cells.place"), F.col("cells.bin")))
    return rows.withColumn(out, 1 / (1 + F.exp(-F.col("_f")))).drop("cells", "_f")
