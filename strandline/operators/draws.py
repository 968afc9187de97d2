"""Multinomial draws of clusters, without a table of clusters times replicates.

m draws fall on the m clusters of a stratum.  Clusters are put in an order by
hash and cut into blocks.  How many draws of a replicate fall into a block is
found by splitting: of the draws of a range of blocks, those of its left half are
binomial, taken from the inverse distribution function at a number fixed by
(seed, stratum, replicate, range).  The counts of whole blocks are a small table, and
a task derives the multiplicities of the clusters of its own blocks, for all
replicates at once, from these counts.  A lost task comes back with the same draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.contracts import required
from strandline.operators.ordering import dense_index
from strandline.session import materialise, ship

BLOCK = 4_096  # clusters whose multiplicities are made together
FAN = 1_024  # ranges of blocks that one task makes of one range before they are dealt anew
TABLE = 1 << 21  # cells of a distribution function held at a time
KEYS = 2_048  # keys whose sums a task holds for all replicates
FEW_ROWS, ROWS = 16_384, 1 << 19  # rows of sums of a task, however many keys they have, and with few keys
TASKS = 32  # that share the work at least, where there are rows for them
STEP = 512  # rows of the matrix taken at a time

# The steps of a 32-bit mixing function.
GOLDEN = 0x9E3779B9
MIX_1, MIX_2 = 0x85EBCA6B, 0xC2B2AE35
WORD = 0xFFFFFFFF


# exact draws of counts ----------------------------------------------------------


def binomial(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Smallest k at which the distribution function of Binomial(n, p) reaches u, row by row.

    The weights run over ten deviations on each side of the mean and ten counts
    more, by the ratios of neighbours.
    """
    n = n.astype(np.int64)
    if p <= 0 or p >= 1:
        return n if p >= 1 else np.zeros_like(n)
    half = int(10 * np.sqrt(float(n.max(initial=0)) * p * (1 - p))) + 10
    out = np.empty(len(n), np.int64)
    step = max(1, TABLE // (2 * half + 1))
    around = np.arange(-half, half + 1)
    for start in range(0, len(n), step):
        size = n[start : start + step, None]
        k = np.floor(size * p).astype(np.int64) + around
        inside = (k >= 0) & (k <= size)
        # from k - 1 to k, where both are counts
        ratio = np.where(inside & (k > 0), (size - k + 1) / np.maximum(k, 1) * (p / (1 - p)), 1.0)
        ratio[:, 0] = 1.0
        weight = np.cumsum(np.log(np.maximum(ratio, 1e-300)), axis=1)
        weight = np.where(inside, weight, -np.inf)
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        total = np.cumsum(weight, axis=1)
        reached = total >= u[start : start + step, None] * total[:, -1:]
        out[start : start + step] = k[np.arange(len(k)), reached.argmax(axis=1)]
    return out


def unit(texts: Sequence[str]) -> np.ndarray:
    """A number in (0, 1) fixed by each text: 13 hex digits of its md5, and a half."""
    return np.array([(int(md5(t.encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for t in texts])


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit numbers, held in 64 bits, well mixed."""
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX_1)) & np.uint64(WORD)
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(MIX_2)) & np.uint64(WORD)
    return x ^ (x >> np.uint64(16))


def multiplicities(text: str, block: int, size: int, counts: np.ndarray) -> np.ndarray:
    """(size, replicates): how often each cluster of a block is drawn.

    Two words a, b are fixed by (stratum, replicate, block); draw j of a replicate
    picks the place mix(mix(a + (j + 1) golden) xor b), scaled to the size.
    """
    reps = len(counts)
    digests = [md5(f"{text}:{r + 1}:{block}".encode()).hexdigest() for r in range(reps)]
    words = np.array([(int(d[:8], 16), int(d[8:16], 16)) for d in digests], np.uint64).reshape(reps, 2)
    out = np.zeros((size, reps), np.int32)
    step = max(1, TABLE // max(1, int(counts.max(initial=0))))
    for first in range(0, reps, step):
        mine = counts[first : first + step]
        rep = np.repeat(np.arange(len(mine)), mine)
        nth = (np.arange(len(rep)) - np.repeat(np.cumsum(mine) - mine, mine) + 1).astype(np.uint64)
        a, b = words[first : first + step].T
        x = mixed(mixed((a[rep] + nth * np.uint64(GOLDEN)) & np.uint64(WORD)) ^ b[rep])
        place = ((x * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
        flat = place * len(mine) + rep
        out[:, first : first + step] = np.bincount(flat, minlength=size * len(mine)).reshape(size, len(mine))
    return out


# the plan of all draws ------------------------------------------------------------


@dataclass
class Draws:
    """Places of the clusters, and how many draws of each replicate fall into each block.

    ``placed``: strata, cluster, ``_block``, ``_i`` (place in the block), ``_pack``.
    ``blocks``: strata, ``_block``, ``_size``, ``_text``, ``_counts``, ``_pack``.
    A pack is some blocks with about ``BLOCK`` clusters, or one large block more.
    """

    strata: list[str]
    cluster: str
    replicates: int
    placed: DataFrame
    blocks: DataFrame
    packs: int

    @property
    def on(self) -> list[str]:
        return [*self.strata, self.cluster]


def split_ranges(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Ranges of blocks (``_first`` to ``_end``) cut into blocks, or into ``FAN`` ranges that are."""
    for batch in batches:
        heads = batch.schema.names[:-3]
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            m, text = (row.column(c)[0].as_py() for c in ("_m", "_text"))
            counts = row.column("_counts").flatten().to_numpy()
            todo, done = [(row.column("_first")[0].as_py(), row.column("_end")[0].as_py(), counts)], []
            while todo and len(todo) + len(done) < FAN:
                first, end, counts = todo.pop(0)
                if end - first <= 1:
                    done.append((first, end, counts))
                    continue
                middle = (first + end) // 2
                left, whole = (middle - first) * block, min(end * block, m) - first * block
                u = unit([f"{text}:{r + 1}:{first}:{end}" for r in range(len(counts))])
                taken = binomial(u, counts, left / whole)
                todo += [(first, middle, taken), (middle, end, counts - taken)]
            done += todo
            lists = pa.array([c for _, _, c in done], pa.list_(pa.int64()))
            repeat = pa.array(np.zeros(len(done), np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[row.column(h).take(repeat) for h in heads],
                    pa.array([f for f, _, _ in done], pa.int64()),
                    pa.array([e for _, e, _ in done], pa.int64()),
                    lists,
                ],
                names=batch.schema.names,
            )


def plan_draws(clusters: DataFrame, strata: Sequence[str], cluster: str, replicates: int, seed: int, block: int = BLOCK) -> Draws:
    """Draws of the distinct clusters of each stratum; one that is alone is kept once in every replicate."""
    strata, spark = list(strata), clusters.sparkSession
    keys = strata or ["_all"]
    members = required(clusters.select(*strata, cluster).distinct(), *strata, cluster)
    lead = [F.lit(str(seed)), *[F.col(c).cast("string") for c in strata]]
    members = members.withColumn("_hash", F.md5(F.concat_ws(":", *lead, F.col(cluster).cast("string"))))
    members = members.withColumn("_lead", F.substring("_hash", 1, 3))
    if not strata:
        members = members.withColumn("_all", F.lit(0))
    indexed = dense_index(members, keys, ["_lead"], ["_hash"], "_at")
    place = F.col("_at")
    placed = indexed.select(
        *keys, cluster, F.floor(place / block).alias("_block"), F.pmod(place, F.lit(block)).cast("int").alias("_i")
    )
    placed = materialise(placed, "places")
    sizes = materialise(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")), "strata")
    ranges = sizes.select(
        *keys,
        "_m",
        F.concat_ws(":", *lead).alias("_text"),
        F.lit(0).cast("long").alias("_first"),
        F.ceil(F.col("_m") / block).alias("_end"),
        F.array_repeat(F.col("_m"), replicates).alias("_counts"),
    )
    ship(spark)
    schema, leaves = ranges.schema, None
    while True:
        made = materialise(ranges.mapInArrow(lambda batches: split_ranges(batches, block), schema), "ranges")
        whole = made.where("_end - _first = 1")
        leaves = whole if leaves is None else leaves.unionByName(whole)
        ranges = made.where("_end - _first > 1")
        if ranges.isEmpty():
            break
        ranges = ranges.repartition(*keys, "_first")
    total = sizes.agg(F.sum("_m")).first()[0] or 0
    packs = max(1, -(-total // block))
    pack = F.pmod(F.xxhash64(*keys, "_block"), F.lit(packs)).alias("_pack")
    blocks = leaves.select(
        *keys, F.col("_first").alias("_block"), F.least(F.lit(block), F.col("_m") - F.col("_first") * block).cast("int").alias("_size"), "_text", "_counts"
    )
    blocks = blocks.select("*", pack)
    return Draws(strata, cluster, replicates, placed.select("*", pack), blocks, packs)


class Matrix:
    """The multiplicities of the blocks of a pack, and where each block's rows begin; inside tasks."""

    def __init__(self, blocks: pa.Table, keys: list[str]):
        names = zip(*[blocks.column(k).to_pylist() for k in (*keys, "_block")])
        sizes = blocks.column("_size").to_pylist()
        self.starts, parts, start = {}, [], 0
        for at, (name, size) in enumerate(zip(names, sizes)):
            self.starts[name] = start
            counts = np.array(blocks.column("_counts")[at].as_py(), np.int64)
            parts.append(multiplicities(blocks.column("_text")[at].as_py(), name[-1], size, counts))
            start += size
        self.rows = np.concatenate(parts) if parts else np.zeros((0, 0), np.int32)

    def at(self, rows: pa.Table, keys: list[str]) -> np.ndarray:
        """Row of the matrix for each row with its block and place."""
        names = [rows.column(k).combine_chunks().dictionary_encode("encode") for k in (*keys, "_block")]
        code = np.zeros(rows.num_rows, np.int64)
        for column in names:
            code = code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
        distinct, first, back = np.unique(code, return_index=True, return_inverse=True)
        starts = [self.starts[tuple(c[int(i)].as_py() for c in names)] for i in first]
        return np.array(starts, np.int64)[back] + rows.column("_i").to_numpy() if len(distinct) else code


def _keys(draws: Draws) -> list[str]:
    return draws.strata or ["_all"]


def draw_table(draws: Draws) -> DataFrame:
    """(stratum.., replicate, cluster, mult) of all drawn clusters: where the draws are themselves a result."""
    keys, heads = _keys(draws), draws.on

    def work(places: pa.Table, blocks: pa.Table) -> pa.Table:
        matrix = Matrix(blocks, keys)
        times = matrix.rows[matrix.at(places, keys)] if places.num_rows else matrix.rows[:0]
        row, rep = np.nonzero(times)
        out = places.select(heads).take(pa.array(row))
        out = out.append_column("replicate", pa.array((rep + 1).astype(np.int32)))
        return out.append_column("mult", pa.array(times[row, rep], pa.int32()))

    ship(draws.placed.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in draws.placed.select(*heads).schema]
    rows = draws.placed.groupBy("_pack").cogroup(draws.blocks.groupBy("_pack"))
    found = rows.applyInArrow(work, ", ".join([*fields, "replicate int", "mult int"]))
    return found.select(*draws.strata, "replicate", draws.cluster, "mult")


def key_parts(rows: int, keys: int, packs: int) -> int:
    """Parts of the keys that are multiplied apart.

    Every part makes the matrix of its pack again, so there are no more than the sums of
    ``KEYS`` keys, ``ROWS`` rows or ``TASKS`` tasks ask for, and with ``FEW_ROWS`` rows
    a part needs no other.
    """
    most = -(-rows // (packs * FEW_ROWS))
    asked = max(-(-keys // KEYS), -(-rows // (packs * ROWS)), -(-TASKS // packs))
    return max(1, min(most, asked))


def added_up(sums: DataFrame, draws: Draws, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(replicate, keys.., measures): ``sums``, one row per (cluster, keys), times the multiplicities.

    A task has the multiplicities of one pack of blocks as a matrix and some of
    the keys (``key_parts``); what leaves it is one row per key, with an array over the
    replicates for each measure.  Measures that are whole numbers stay so.
    """
    keys, measures, strata, replicates = list(keys), list(measures), _keys(draws), draws.replicates
    own = [f"_k{i}" for i in range(len(keys))]
    rows = sums.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], *draws.on, *measures)
    rows = rows if draws.strata else rows.withColumn("_all", F.lit(0))
    rows = materialise(rows.join(draws.placed, [*strata, draws.cluster]).drop(draws.cluster), "cluster-sums")
    kinds = {m: "long" if rows.schema[m].dataType.typeName() in ("long", "integer", "byte", "short") else "double" for m in measures}
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*own) if own else F.lit(0)).alias("keys")).first()
    parts = key_parts(facts["n"], facts["keys"], draws.packs)
    part = F.pmod(F.xxhash64(*own), F.lit(parts)) if own else F.lit(0)
    left = rows.select("*", part.cast("long").alias("_part"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part")
    right = draws.blocks.select("*", copies)

    def work(table: pa.Table, blocks: pa.Table) -> pa.Table:
        codes = [table.column(k).combine_chunks().dictionary_encode("encode") for k in own]
        code = np.zeros(table.num_rows, np.int64)
        for column in codes:
            # codes are made dense again, so that products of many keys fit
            code = code * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
            code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        place = code[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out = [np.zeros((len(first), replicates)) for _ in measures]
        if table.num_rows:
            matrix = Matrix(blocks, strata)
            at, times = matrix.at(table, strata)[order], matrix.rows.astype(float)
            values = np.array([table.column(m).to_numpy(zero_copy_only=False).astype(float)[order] for m in measures])
            ends = np.append(first[1:], len(place))
            for key, (start, end) in enumerate(zip(first, ends)):
                for low in range(start, end, STEP):
                    mine = slice(low, min(end, low + STEP))
                    # all measures of a key by one product with the rows of its clusters
                    for total, added in zip(out, values[:, mine] @ times[at[mine]]):
                        total[key] += added
        heads = [table.column(k).take(pa.array(order[first])) for k in own]
        offsets = pa.array(np.arange(len(first) + 1) * replicates, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(total.ravel())) for total in out]
        return pa.table([*heads, *lists], names=[*own, *measures])

    ship(rows.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema] + [f"`{m}` array<double>" for m in measures]
    found = left.groupBy("_pack", "_part").cogroup(right.groupBy("_pack", "_part")).applyInArrow(work, ", ".join(fields))
    each = found.select(*own, F.posexplode(F.arrays_zip(*measures)).alias("replicate", "_m"))
    replicate = (F.col("replicate") + 1).alias("replicate")
    if draws.packs == 1:  # every key is in one task
        added = each.select(replicate, *own, *[F.col("_m")[m].alias(m) for m in measures])
    else:
        added = each.groupBy(replicate, *own).agg(*[F.sum(F.col("_m")[m]).alias(m) for m in measures])
    return added.select("replicate", *[F.col(o).alias(k) for k, o in zip(keys, own)], *[F.col(m).cast(kinds[m]).alias(m) for m in measures])


def event_counts(bins: DataFrame, groups: Sequence[str], n: str, events: str, replicates: int, seed: int) -> DataFrame:
    """(groups.., replicate, n, events): events among n rows drawn with replacement from n rows.

    The count is binomial, so no row is drawn: one row per group and replicate.
    """
    groups = list(groups)
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(g).cast("string") for g in groups]).alias("_text")
    source = required(bins, *groups, n, events).select(*groups, text, F.col(n).cast("long").alias("n"), F.col(events).cast("long").alias("events"))
    width = len(groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                text, size, found = (row.column(c)[0].as_py() for c in range(width, width + 3))
                u = unit([f"{text}:{r + 1}" for r in range(replicates)])
                drawn = binomial(u, np.full(replicates, size), found / size)
                repeat = pa.array(np.zeros(replicates, np.int64))
                heads = [row.column(i).take(repeat) for i in range(width)]
                rest = [pa.array(np.arange(1, replicates + 1), pa.int32()), pa.array(np.full(replicates, size)), pa.array(drawn)]
                yield pa.RecordBatch.from_arrays([*heads, *rest], names=[*groups, "replicate", "n", "events"])

    ship(bins.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*groups).schema]
    return source.mapInArrow(work, ", ".join([*fields, "replicate int", "n long", "events long"]))


# the same rules in SQL ----------------------------------------------------------------

LEVELS = 6


def _window_sql(n: str, p: str) -> str:
    spread = f"(floor(10 * sqrt({n} * {p} * (1 - {p})))::BIGINT + 10)"
    return f"unnest(range(greatest(0, floor({n} * {p})::BIGINT - {spread}), least({n}, floor({n} * {p})::BIGINT + {spread}) + 1))"


def binomial_sql(source: str, keys: str, n: str, p: str, u: str, keep: str) -> str:
    """``keys``, ``keep`` and the binomial ``k`` of every row of ``source``."""
    centre = f"floor({n} * {p})"
    log = lambda j: f"(lgamma({n} + 1) - lgamma({j} + 1) - lgamma({n} - {j} + 1) + {j} * ln({p}) + ({n} - {j}) * ln(1 - {p}))"
    return f"""SELECT {keys}, {keep}, CASE WHEN any_value({p}) >= 1 THEN any_value({n}) WHEN any_value({p}) <= 0 THEN 0
  ELSE min(j) FILTER (WHERE f >= {u} * t) END::BIGINT AS k FROM (
  SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY j) AS f, sum(w) OVER (PARTITION BY {keys}) AS t FROM (
    SELECT *, CASE WHEN {p} <= 0 OR {p} >= 1 THEN 1 ELSE exp({log("j")} - {log(centre)}) END AS w FROM (
      SELECT *, {_window_sql(n, p)} AS j FROM {source})))
GROUP BY ALL"""


def unit_sql(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)"


def draws_sql(source: str, strata: str, cluster: str, reps: int, seed: int, block: int = BLOCK) -> str:
    """(stratum, replicate, cluster, mult) in DuckDB SQL, for up to 2^LEVELS blocks in a stratum."""
    key = strata or "one"
    lead = f"'{seed}:' || {strata}" if strata else f"'{seed}'"
    step = lambda x, by, times: f"((xor({x}, {x} >> {by}) * {times}::UBIGINT) & {WORD}::UBIGINT)"
    mix = f"(SELECT * REPLACE (xor(x, x >> 16) AS x) FROM (SELECT * REPLACE ({step('x', 13, MIX_2)} AS x) FROM (SELECT * REPLACE ({step('x', 16, MIX_1)} AS x) FROM {{}})))"
    levels = [
        f"t0 AS (SELECT {key}, replicate, 0::BIGINT AS first, ceil(m / {block}::DOUBLE)::BIGINT AS stop, m, m::BIGINT AS c FROM "
        f"(SELECT {key}, any_value(m) AS m FROM placed GROUP BY 1), (SELECT unnest(range(1, {reps + 1}))::INT AS replicate))"
    ]
    text = f"{lead} || ':' || replicate || ':' || first || ':' || stop"
    for d in range(LEVELS):
        part = f"""(SELECT *, (first + stop) // 2 AS middle, ((first + stop) // 2 - first) * {block} / (least(stop * {block}, m) - first * {block})::DOUBLE AS p,
    {unit_sql(text)} AS u FROM t{d} WHERE stop - first > 1)"""
        levels.append(f"s{d} AS ({binomial_sql(part, f'{key}, replicate, first, stop', 'c', 'p', 'u', 'middle, m, c, p, u')})")
        levels.append(
            f"t{d + 1} AS (SELECT {key}, replicate, first, middle AS stop, m, k AS c FROM s{d} UNION ALL SELECT {key}, replicate, middle, stop, m, c - k FROM s{d})"
        )
    leaves = " UNION ALL ".join(f"SELECT * FROM t{d} WHERE stop - first = 1" for d in range(LEVELS + 1))
    return f"""WITH placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS m FROM
    (SELECT *, md5({lead} || ':' || {cluster}) AS h FROM (SELECT DISTINCT {strata or '1 AS one'}, {cluster} FROM {source}))),
{', '.join(levels)},
leaf AS (SELECT *, md5({lead} || ':' || replicate || ':' || first) AS h, least({block}, m - first * {block}) AS size FROM ({leaves})),
words AS (SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT AS a, ('0x' || substr(h, 9, 8))::UBIGINT AS b FROM leaf),
drawn AS (SELECT {key}, replicate, first, size, b, (a + (unnest(range(c)) + 1)::UBIGINT * {GOLDEN}::UBIGINT) & {WORD}::UBIGINT AS x FROM words),
again AS (SELECT * REPLACE (xor(x, b) AS x) FROM {mix.format("drawn")}),
picked AS (SELECT {key}, replicate, first * {block} + ((x * size::UBIGINT) >> 32)::BIGINT AS i, count(*)::INT AS mult FROM {mix.format("again")} GROUP BY ALL)
SELECT {strata + ', ' if strata else ''}replicate, {cluster}, mult FROM picked JOIN placed USING ({key}, i)"""
