"""Leaf-wise boosted trees: the first tree against its twin, and a whole fit."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strandline.operators import leafwise
from strandline.operators.metrics import binary_metrics
from strandline.operators.ordering import linear_quantile
from strandline.plans.modelling import full_design, model_rows, split
from strandline.plans.registry import query, rounded, sql
from strandline.session import materialise

PLACES = ("age", "severity", "risk", "stay", "charge", "prior_count_180d", "prior_stay_sum_180d", "female")
FIRST = replace(leafwise.GRID[0], least_rows=20, row_share=1.0)
EIGHTHS = [i / 8 for i in range(1, 8)]
PART = f"pow(%s - %s * p0, 2) / (%s * p0 * (1 - p0) + {FIRST.penalty}::DOUBLE)"


def _gain() -> str:
    side = lambda pos, n: PART % (pos, n, n)
    return f"{side('pos_left', 'n_left')} + {side('(pos_all - pos_left)', '(n_all - n_left)')} - {side('pos_all', 'n_all')}"


def first_tree_sql() -> str:
    """One step per split: sums of all leaves, the cut with the largest gain, the rows moved."""
    edges = "list_sort(list_distinct([0.0::DOUBLE, {}]))"
    cuts = lambda c: edges.format(", ".join(f"round(quantile_cont({c}, {q}), 6)" for q in EIGHTHS))
    number = lambda c: f"len(list_filter(e.{c}, lambda x: x < d.{c}))"
    steps = [f"d AS MATERIALIZED (SELECT enc_id, y, {', '.join(f'coalesce({c}::DOUBLE, 0) AS {c}' for c in PLACES)} FROM model_rows WHERE year <= 1998)"]
    steps.append(f"e AS MATERIALIZED (SELECT {', '.join(f'{cuts(c)} AS {c}' for c in PLACES)} FROM d)")
    steps.append("base AS MATERIALIZED (SELECT avg(y) AS p0 FROM d)")
    cells = ", ".join(f"{{'place': {k}, 'bin': {number(c)}}}" for k, c in enumerate(PLACES))
    steps.append(f"m0 AS MATERIALIZED (SELECT enc_id, y, 1::BIGINT AS node, [{cells}] AS cells FROM d, e)")
    for k in range(1, FIRST.leaves):
        steps.append(f"""s{k} AS MATERIALIZED (SELECT *, {_gain()} AS gain FROM (
  SELECT node, place, bin, sum(n) OVER w AS n_left, sum(pos) OVER w AS pos_left, sum(n) OVER g AS n_all, sum(pos) OVER g AS pos_all
  FROM (SELECT node, c.place, c.bin, count(*) AS n, sum(y) AS pos FROM (SELECT node, y, unnest(cells) AS c FROM m{k - 1}) GROUP BY ALL)
  WINDOW g AS (PARTITION BY node, place), w AS (PARTITION BY node, place ORDER BY bin)), base
  WHERE least(n_left, n_all - n_left) >= {FIRST.least_rows} AND least(n_left, n_all - n_left) * p0 * (1 - p0) >= {leafwise.LEAST_CURVATURE}
    AND {_gain()} > 1e-9
  ORDER BY round(gain, 9) DESC, node, place, bin LIMIT 1)""")
        steps.append(f"""m{k} AS MATERIALIZED (SELECT enc_id, y, cells, CASE WHEN m.node = s.node
  THEN 2 * m.node + (cells[s.place + 1].bin > s.bin)::BIGINT ELSE m.node END AS node FROM m{k - 1} m LEFT JOIN s{k} s ON true)""")
    shown = " UNION ALL ".join(
        f"SELECT {k} AS step, node, place, bin::INT AS upto, round(gain, 6) AS gain, n_left::BIGINT AS n_left, (n_all - n_left)::BIGINT AS n_right FROM s{k}"
        for k in range(1, FIRST.leaves)
    )
    return sql(f"WITH {', '.join(steps)} {shown}", "model_rows")


@query("leafwise_first_tree", first_tree_sql())
def leafwise_first_tree(spark, sf_dir):
    """Every split of the first tree, in the order in which the leaves were split."""
    development, _ = split(model_rows(spark, sf_dir))
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in PLACES]
    rows = materialise(development.select("y", array_to_vector(F.array(*numbers)).alias("features"), F.array(*numbers).alias("x")), "tree-rows")
    values = rows.select(F.posexplode("x").alias("place", "value"))
    cuts = [linear_quantile(values, ["place"], "value", q).select("place", F.round("value", 6).alias("value")) for q in EIGHTHS]
    together = cuts[0]
    for part in cuts[1:]:
        together = together.unionByName(part)
    edges = together.groupBy("place").agg(F.array_sort(F.array_union(F.collect_set("value"), F.array(F.lit(0.0)))).alias("edges"))
    edges = materialise(edges.withColumn("zero", F.array_position("edges", F.lit(0.0)).cast("int") - 1), "tree-edges")
    start = leafwise.starting_score(rows, "y")
    ready = materialise(leafwise.binned(rows, "features", edges).select("y", "cells").withColumn("f", F.lit(start)), "tree-cells")
    tree = leafwise.grow(leafwise.with_slopes(ready, "y"), FIRST)
    out = []
    for step, node in enumerate(tree.order, 1):
        cut = tree.cuts[node]
        below = [s.n for k, s in tree.leaves.items() if _under(k, 2 * node + 1)]
        out.append((step, node, cut.place, cut.upto, cut.gain, cut.left.n, sum(below)))
    return rounded(spark.createDataFrame(out, "step int, node long, place int, upto int, gain double, n_left long, n_right long"))


def _under(node: int, root: int) -> bool:
    while node > root:
        node //= 2
    return node == root


@query("leafwise_boosted_trees")
def leafwise_boosted_trees(spark, sf_dir):
    """The first setting, stopped on the last development year and compared on the later years."""
    development, later = split(full_design(spark, sf_dir))
    marked = development.withColumn("is_validation", F.col("year") == 1998)
    forest = leafwise.fit(marked, "enc_id", "y", "is_validation", "features", leafwise.GRID[0])
    scored = leafwise.score(forest, later, "features").select("y", "p")
    metrics = binary_metrics(materialise(scored, "leafwise"), [], "p", "y")
    return rounded(metrics.withColumn("trees", F.lit(len(forest.trees))).withColumn("leaves", F.lit(sum(len(t.leaves) for t in forest.trees))))
