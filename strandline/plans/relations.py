"""Joins with contracts, set operations, checks, aggregates and quantiles."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.values import at_base_year, cost_from_charge, platt
from strandline.operators import aggregates as G
from strandline.operators import contracts as K
from strandline.operators import hashtree as HT
from strandline.operators import joins as J
from strandline.operators import ordering as O
from strandline.operators.skew import lookup_join
from strandline.plans.bindings import (
    admissions,
    encounters,
    scored_documents,
    scored_lines,
    sql_in,
    table,
    unique_lines,
)
from strandline.plans.linkage import episodes, histories, partition_label
from strandline.plans.registry import cte, query, rnd, rounded, sql
from strandline.plans.scalars import BASE_INDEX, INDEX
from strandline.plans.stages import staged
from strandline.session import scratch_path

# Nations that the ratio table leaves out.
NO_RATIO = (3, 11)
_FACTOR = "CASE year " + " ".join(f"WHEN {y} THEN {BASE_INDEX}::DOUBLE / {v}::DOUBLE" for y, v in INDEX.items()) + " END"

cte(
    "ratios",
    f"SELECT n_nationkey, 0.2::DOUBLE + n_nationkey / 50.0::DOUBLE AS ratio FROM nation WHERE n_nationkey NOT IN {sql_in(NO_RATIO)}",
)
cte(
    "enriched",
    f"""SELECT a.enc_id, a.year, a.entity_id, s.s_nationkey AS stratum, a.facility_id, n.n_regionkey AS region, a.severity, a.planned_status,
  1 + s.s_nationkey / 10.0::DOUBLE AS facility_weight, r.ratio,
  CASE WHEN a.charge > 0 AND r.ratio > 0 THEN a.charge * r.ratio END AS cost,
  CASE WHEN a.charge > 0 AND r.ratio > 0 THEN a.charge * r.ratio * {_FACTOR} END AS cost_adjusted,
  CASE WHEN a.facility_id IS NULL THEN 'no_line' WHEN s.s_suppkey IS NULL THEN 'unknown_facility' ELSE 'linked' END AS facility_state
FROM adm a LEFT JOIN supplier s ON s.s_suppkey = a.facility_id LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN ratios r ON r.n_nationkey = s.s_nationkey""",
    "adm",
    "ratios",
)


def ratio_table(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where(~F.col("n_nationkey").isin(list(NO_RATIO)))
    return nation.select(F.col("n_nationkey").alias("stratum"), (0.2 + F.col("n_nationkey") / 50.0).alias("ratio"))


@staged
def enriched(spark, sf_dir):
    """Encounters with severity, facility and cost ratio; no encounter may get lost.

    An encounter without any line has no facility; it stays, and says so.
    """
    facility = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("facility_id"), F.col("s_nationkey").alias("stratum")
    )
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stratum"), F.col("n_regionkey").alias("region"))
    core = admissions(spark, sf_dir).select("enc_id", "year", "entity_id", "facility_id", "planned_status", "charge", "severity")
    out = lookup_join(core, facility, ["facility_id"], "left")
    out = lookup_join(out, nation, ["stratum"], "left")
    out = lookup_join(out, ratio_table(spark, sf_dir), ["stratum"], "left")
    cost = cost_from_charge(F.col("charge"), F.col("ratio"))
    out = out.withColumns(
        {
            "facility_weight": 1 + F.col("stratum") / 10.0,
            "facility_state": F.when(F.col("facility_id").isNull(), "no_line").when(F.col("stratum").isNull(), "unknown_facility").otherwise("linked"),
            "cost": cost,
            "cost_adjusted": at_base_year(cost, F.col("year"), INDEX, BASE_INDEX),
        }
    )
    return K.require_same_count(encounters(spark, sf_dir), out).drop("charge")


ENRICHED = ("enc_id", "year", "entity_id", "facility_id", "stratum", "region", "severity", "planned_status", "facility_weight", "facility_state")


@query("enriched_encounters", sql(f"SELECT {', '.join(ENRICHED)} FROM enriched", "enriched"))
def enriched_encounters(spark, sf_dir):
    return rounded(K.require_no_columns(enriched(spark, sf_dir)).select(*ENRICHED))


@query(
    "left_ratio_lookup",
    sql("SELECT enc_id, ratio, cost, cost_adjusted FROM enriched", "enriched"),
)
def left_ratio_lookup(spark, sf_dir):
    return enriched(spark, sf_dir).select("enc_id", "ratio", "cost", "cost_adjusted")


@query(
    "checked_history_join",
    sql("SELECT e.enc_id, e.leaf, h.prior_count_ytd, h.days_since_prior FROM eps e JOIN hist h USING (enc_id) WHERE e.eligible", "hist"),
)
def checked_history_join(spark, sf_dir):
    index = episodes(spark, sf_dir).where("eligible").select("enc_id", "entity_id", "leaf")
    history = histories(spark, sf_dir).select("enc_id", "entity_id", "prior_count_ytd", "days_since_prior")
    return J.checked_join(index, history, ["enc_id"], agree=["entity_id"]).drop("entity_id")


@query(
    "label_alignment",
    "SELECT true AS aligned, false AS shifted_aligned, count(*) AS n FROM labels JOIN documents USING (doc_id)",
)
def label_alignment(spark, sf_dir):
    """Two tables must hold the same keys and weights; a changed one must be told apart."""
    scored = scored_documents(spark, sf_dir)
    left, right = scored.select("doc_id", "weight"), scored.select("weight", "doc_id")
    shifted = right.withColumn("weight", F.col("weight") + 1)
    return left.agg(
        F.lit(J.same_rows(left, right)).alias("aligned"),
        F.lit(J.same_rows(left, shifted)).alias("shifted_aligned"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "paired_scores",
    sql("SELECT doc_id, p AS raw, round(1 / (1 + exp(-(0.1::DOUBLE + ln(p / (1 - p))))), 6) AS calibrated FROM docs", "docs"),
)
def paired_scores(spark, sf_dir):
    raw = scored_documents(spark, sf_dir).select("doc_id", F.col("p").alias("raw"))
    calibrated = scored_documents(spark, sf_dir).select("doc_id", rnd(platt(F.col("p"), 0.1, 1.0)).alias("calibrated"))
    return J.checked_join(raw, calibrated, ["doc_id"])


# set operations -----------------------------------------------------------------------

@query(
    "set_operations",
    """WITH big AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000),
urgent AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'both' AS part, k FROM (SELECT k FROM big INTERSECT SELECT k FROM urgent) UNION ALL
SELECT 'either', k FROM (SELECT k FROM big UNION SELECT k FROM urgent) UNION ALL
SELECT 'only_big', k FROM (SELECT k FROM big EXCEPT SELECT k FROM urgent)""",
)
def set_operations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    big = orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct()
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    parts = {"both": big.intersect(urgent), "either": big.union(urgent).distinct(), "only_big": big.join(urgent, "k", "left_anti")}
    out = [df.select(F.lit(name).alias("part"), "k") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "key_disjointness",
    sql(
        """SELECT partition_label, count(*) AS entities, 0::BIGINT AS shared FROM (SELECT DISTINCT partition_label, year, entity_id FROM parts) GROUP BY 1""",
        "parts",
    ),
)
def key_disjointness(spark, sf_dir):
    """Entities of one year lie in one partition only."""
    keys = episodes(spark, sf_dir).select(partition_label().alias("partition_label"), "year", "entity_id").distinct()
    per_entity = keys.withColumn("n", F.lit(1)).groupBy("year", "entity_id").agg(F.count("n").alias("n"))
    marked = keys.join(per_entity, ["year", "entity_id"])
    return marked.groupBy("partition_label").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n") > 1).alias("shared")
    )


# contracts ------------------------------------------------------------------------------

@query(
    "null_counts",
    sql(
        """SELECT count(*) FILTER (WHERE payer IS NULL) AS payer, count(*) FILTER (WHERE elective IS NULL) AS elective,
  count(*) FILTER (WHERE severity IS NULL) AS severity, count(*) FILTER (WHERE charge IS NULL) AS charge FROM enc""",
        "enc",
    ),
)
def null_counts(spark, sf_dir):
    return K.null_counts(encounters(spark, sf_dir).select("payer", "elective", "severity", "charge"))


@query(
    "duplicate_keys",
    """SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys,
  count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem""",
)
def duplicate_keys(spark, sf_dir):
    return K.key_repeats(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("schema_contract", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def schema_contract(spark, sf_dir):
    kinds = {"c_custkey": T.LongType(), "c_name": T.StringType(), "c_nationkey": T.IntegerType()}
    kinds |= {"c_acctbal": T.DoubleType(), "c_mktsegment": T.StringType()}
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])
    return K.require_schema(table(spark, sf_dir, "customer"), schema)


@query(
    "score_table_contract",
    sql(
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (weight > 0)) AS weight, 0::BIGINT AS outcome,
  count(*) FILTER (WHERE NOT (p_fine BETWEEN 0 AND 0.5)) AS p_below_half, count(*) FILTER (WHERE p_tied NOT BETWEEN 0 AND 1) AS p_tied FROM scored""",
        "scored",
    ),
)
def score_table_contract(spark, sf_dir):
    """Counts of broken rules; one rule is set too tight on purpose."""
    return K.violations(
        scored_lines(spark, sf_dir),
        {
            "weight": K.is_finite(F.col("weight")) & (F.col("weight") > 0),
            "outcome": K.is_binary(F.col("y_any")),
            "p_below_half": K.is_probability(F.col("p_fine")) & (F.col("p_fine") <= 0.5),
            "p_tied": K.is_probability(F.col("p_tied")),
        },
    )


@query(
    "binary_null_contract",
    sql(
        """SELECT count(*) AS n_rows, 0::BIGINT AS died, count(*) FILTER (WHERE elective IS NULL) AS elective, 0::BIGINT AS elective_or_null FROM enc""", "enc"
    ),
)
def binary_null_contract(spark, sf_dir):
    return K.violations(
        encounters(spark, sf_dir),
        {
            "died": K.is_binary(F.col("died")),
            "elective": K.is_binary(F.col("elective")),
            "elective_or_null": K.is_binary(F.col("elective"), allow_null=True),
        },
    )


@query(
    "hierarchy_contract",
    sql(
        """SELECT count(*) AS n_rows, 0::BIGINT AS leaf_range, 0::BIGINT AS parent_is_leaf, 0::BIGINT AS causes_exclusive, 0::BIGINT AS causes_match_leaf FROM eps WHERE eligible""",
        "eps",
    ),
)
def hierarchy_contract(spark, sf_dir):
    rules = K.hierarchy_rules("any_follow_up", "leaf", ["leaf_1", "leaf_2", "leaf_3"])
    return K.violations(episodes(spark, sf_dir).where("eligible"), rules)


@query(
    "minimum_derivative",
    sql(
        """SELECT e.enc_id, e.year, e.leaf, e.any_follow_up::INT AS outcome_any, e.leaf_1::INT AS outcome_1, e.leaf_2::INT AS outcome_2,
  e.leaf_3::INT AS outcome_3, h.prior_count_180d FROM eps e JOIN hist h USING (enc_id) WHERE e.eligible""",
        "hist",
    ),
)
def minimum_derivative(spark, sf_dir):
    """Exact output columns, after contracts on labels, hierarchy and the history join."""
    as_int = {f"outcome_{k}": F.col(f"leaf_{k}").cast("int") for k in (1, 2, 3)}
    index = episodes(spark, sf_dir).where("eligible").withColumns({"outcome_any": F.col("any_follow_up").cast("int"), **as_int})
    K.require(index, K.hierarchy_rules("outcome_any", "leaf", list(as_int)))
    K.require(index, {c: K.is_binary(F.col(c)) for c in ("outcome_any", *as_int)})
    slim = index.select("enc_id", "entity_id", "year", "leaf", "outcome_any", *as_int)
    history = histories(spark, sf_dir).select("enc_id", "entity_id", "prior_count_180d")
    return J.checked_join(slim, history, ["enc_id"], agree=["entity_id"]).drop("entity_id")


@query(
    "partition_gate",
    sql("SELECT enc_id, year FROM parts WHERE partition_label = 'development' AND eligible", "parts"),
)
def partition_gate(spark, sf_dir):
    rows = episodes(spark, sf_dir).where("eligible").withColumn("label", partition_label())
    rows = rows.where("label = 'development'").select("enc_id", "year", "label")
    K.require_partition(rows, "year", [1995, 1996, 1997, 1998, 1999], "label", "development", "enc_id")
    return rows.drop("label")


@query("row_count_conservation", "SELECT count(*) AS n_in, count(*) AS n_out FROM lineitem JOIN part ON l_partkey = p_partkey")
def row_count_conservation(spark, sf_dir):
    """Counts observed while the joined table is written, not by extra scans."""
    lines, seen_in = K.observed_count(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "in")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    joined, seen_out = K.observed_count(lines.join(part, "l_partkey"), "out")
    joined.write.parquet(scratch_path(spark, "joined"))
    counts = [(seen_in.get["n"], seen_out.get["n"])]
    return spark.createDataFrame(counts, "n_in bigint, n_out bigint")


@query(
    "table_fingerprint",
    """SELECT count(*) AS n_rows, sum(('0x' || substr(md5(c_custkey || chr(1) || c_mktsegment || chr(1) || c_name || chr(1) || c_nationkey), 1, 15))::BIGINT::DECIMAL(38,0))::VARCHAR AS content FROM customer""",
)
def table_fingerprint(spark, sf_dir):
    return K.fingerprint(table(spark, sf_dir, "customer").drop("c_acctbal"))


_BAND = "(o_orderkey // 50) % 20 = 7"


@query(
    "repaired_table_differences",
    f"""WITH old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
new AS (SELECT o_orderkey, o_custkey, CASE WHEN {_BAND} AND o_orderkey % 5 = 1 THEN 'R' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM old
    WHERE NOT ({_BAND} AND o_orderkey % 5 = 0)
  UNION ALL SELECT -o_orderkey, o_custkey, NULL, o_totalprice FROM old WHERE {_BAND} AND o_orderkey % 50 = 2)
SELECT o_orderkey, CASE WHEN o.o_custkey IS NULL THEN 'ADDED' WHEN n.o_custkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS status
FROM old o FULL JOIN new n USING (o_orderkey)
WHERE o.o_custkey IS NULL OR n.o_custkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.o_totalprice IS DISTINCT FROM n.o_totalprice""",
)
def repaired_table_differences(spark, sf_dir):
    """Orders and a repaired version of them, compared by their hash trees; only ranges that differ are read."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    band = F.pmod(F.floor(key / 50), F.lit(20)) == 7
    status = F.when(band & (key % 5 == 1), "R").otherwise(F.col("o_orderstatus"))
    kept = old.where(~(band & (key % 5 == 0))).withColumn("o_orderstatus", status)
    more = old.where(band & (key % 50 == 2)).withColumns({"o_orderkey": -key, "o_orderstatus": F.lit(None).cast("string")})
    ends = old.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    ranged = HT.even_range(key, ends["low"], ends["high"])
    paths = [scratch_path(spark, name) for name in ("orders-old", "orders-new")]
    HT.publish(old, paths[0], "o_orderkey", ranged)
    HT.publish(kept.unionByName(more), paths[1], "o_orderkey", ranged)
    return HT.differences(spark, *paths, "o_orderkey")


# aggregates ------------------------------------------------------------------------------

@query(
    "weighted_moments",
    sql(
        """SELECT line_no, round(sum(weight * p_fine) / sum(weight), 6) AS mean,
  round(sqrt(sum(weight * p_fine * p_fine) / sum(weight) - (sum(weight * p_fine) / sum(weight)) ** 2), 6) AS sd,
  round(sum(weight * y_any) / sum(weight), 6) AS rate FROM scored GROUP BY 1""",
        "scored",
    ),
)
def weighted_moments(spark, sf_dir):
    p, w = F.col("p_fine"), F.col("weight")
    return rounded(
        scored_lines(spark, sf_dir).groupBy("line_no").agg(
            G.weighted_mean(p, w).alias("mean"), G.weighted_sd(p, w).alias("sd"), G.weighted_mean(F.col("y_any"), w).alias("rate")
        )
    )


LEVELS = ["1", "2", "3", "9"]


@query(
    "weighted_level_shares",
    sql(
        """SELECT l.level, coalesce(round(s.w / (SELECT sum(weight) FROM scored), 6), 0.0::DOUBLE) AS share
FROM (SELECT unnest(['1', '2', '3', '9']) AS level) l LEFT JOIN (SELECT line_no::VARCHAR AS level, sum(weight) AS w FROM scored GROUP BY 1) s USING (level)""",
        "scored",
    ),
)
def weighted_level_shares(spark, sf_dir):
    rows = scored_lines(spark, sf_dir).withColumn("level", F.col("line_no").cast("string"))
    return rounded(G.level_shares(rows, "level", "weight", LEVELS))


def _step_sql(source, value, weight, q, groups=""):
    part = f"PARTITION BY {groups}" if groups else ""
    return f"""SELECT {groups + ', ' if groups else ''}min(v) AS v FROM (SELECT {groups + ', ' if groups else ''}{value} AS v,
  sum({weight}) OVER ({part} ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
  sum({weight}) OVER ({part}) AS tw FROM {source}) WHERE cw >= {q} * tw {'GROUP BY ' + groups if groups else ''}"""


@query(
    "weighted_quantile_step",
    sql(f"SELECT year, v AS value FROM ({_step_sql('(SELECT * FROM enc WHERE age >= 18)', 'charge', 'weight', 0.9, 'year')})", "enc"),
)
def weighted_quantile_step(spark, sf_dir):
    adults = encounters(spark, sf_dir).where("age >= 18")
    return O.weighted_step_quantile(adults, ["year"], "charge", "weight", 0.9).select("year", "value")


@query(
    "high_cost_threshold",
    sql(
        f"""SELECT 'weighted_p90' AS rule, v AS threshold FROM ({_step_sql("(SELECT * FROM enc WHERE year <= 1998)", "charge", "weight", 0.9)})
UNION ALL SELECT 'unweighted_p90', round(quantile_cont(charge, 0.9), 4) FROM enc WHERE year <= 1998""",
        "enc",
    ),
)
def high_cost_threshold(spark, sf_dir):
    development = encounters(spark, sf_dir).where("year <= 1998")
    weighted = O.weighted_step_quantile(development, [], "charge", "weight", 0.9, "threshold")
    plain = O.linear_quantile(development, [], "charge", 0.9, "threshold")
    named = lambda df, name: df.select(F.lit(name).alias("rule"), "threshold")
    return named(weighted, "weighted_p90").unionByName(rounded(named(plain, "unweighted_p90"), 4))


_QS = (0.1, 0.5, 0.9)


@query(
    "weighted_quantile_midpoint",
    sql(
        """WITH c AS (SELECT line_no, p_fine AS x, (sum(weight) OVER (PARTITION BY line_no ORDER BY p_fine, row_id ROWS UNBOUNDED PRECEDING) - weight / 2)
    / sum(weight) OVER (PARTITION BY line_no) AS c FROM uniq),
q AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q),
lo AS (SELECT line_no, q, max(c) AS c, arg_max(x, {'c': c, 'x': x}) AS x FROM c, q WHERE c <= q GROUP BY 1, 2),
hi AS (SELECT line_no, q, min(c) AS c, arg_min(x, {'c': c, 'x': x}) AS x FROM c, q WHERE c >= q GROUP BY 1, 2)
SELECT line_no, list(round(CASE WHEN hi.c > lo.c THEN lo.x + (hi.x - lo.x) * (q - lo.c) / (hi.c - lo.c) ELSE lo.x END, 6) ORDER BY q) AS "values"
FROM lo JOIN hi USING (line_no, q) GROUP BY 1""",
        "uniq",
    ),
)
def weighted_quantile_midpoint(spark, sf_dir):
    out = O.midpoint_quantiles(unique_lines(spark, sf_dir), ["line_no"], "p_fine", "weight", "row_id", _QS)
    return out.select("line_no", F.transform("values", lambda v: rnd(v)).alias("values"))


@query(
    "linear_quantile",
    sql("SELECT year, count(*) AS n, round(quantile_cont(charge, 0.3), 4) AS value FROM enc GROUP BY 1", "enc"),
)
def linear_quantile(spark, sf_dir):
    return rounded(O.linear_quantile(encounters(spark, sf_dir), ["year"], "charge", 0.3), 4)


@query(
    "upper_quantile",
    sql(
        """SELECT year, count(*) AS n, list(charge ORDER BY charge)[ceil((count(*) - 1) * 0.8::DOUBLE)::INT + 1] AS value FROM enc GROUP BY 1""", "enc"
    ),
)
def upper_quantile(spark, sf_dir):
    return O.upper_quantile(encounters(spark, sf_dir), ["year"], "charge", 0.8)


@query(
    "order_statistic",
    sql(
        """SELECT year, count(*) AS n, list(charge ORDER BY charge)[least(count(*), ceil((count(*) + 1) * (1.0::DOUBLE - 0.1::DOUBLE))::BIGINT)] AS value
FROM enc GROUP BY 1""",
        "enc",
    ),
)
def order_statistic(spark, sf_dir):
    rank = lambda n: F.least(n, F.ceil((n + 1) * F.lit(1 - 0.1)))
    return O.order_statistic(encounters(spark, sf_dir), ["year"], "charge", rank)


@query(
    "stay_histogram",
    sql(
        """SELECT stay, n, round(w, 4) AS w, round(sum(w) OVER (ORDER BY stay), 4) AS cum_w FROM
  (SELECT stay, count(*) AS n, sum(weight) AS w FROM enc WHERE year <= 1998 GROUP BY 1)""",
        "enc",
    ),
)
def stay_histogram(spark, sf_dir):
    histogram = G.count_and_weight(encounters(spark, sf_dir).where("year <= 1998"), "stay", "weight")
    return rounded(O.running_totals(histogram, [], "stay", ["w"]), 4)


@query(
    "bounded_moments",
    sql("SELECT count(*) AS n, round(avg(age), 6) AS mean, round(stddev_pop(age), 6) AS sd FROM enc WHERE age BETWEEN 18 AND 80", "enc"),
)
def bounded_moments(spark, sf_dir):
    return rounded(G.moments(encounters(spark, sf_dir), "age", 18, 80))


@query(
    "capped_positive_weight",
    """SELECT lang, sum(quality)::BIGINT AS positive, count(*) AS valid, round(least(20, (count(*) - sum(quality)) / sum(quality)::DOUBLE), 6) AS weight
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING sum(quality) > 0 AND sum(quality) < count(*)""",
)
def capped_positive_weight(spark, sf_dir):
    by = scored_documents(spark, sf_dir).groupBy("lang").agg(F.sum("y").alias("positive"), F.count(F.lit(1)).alias("valid"))
    by = by.where((F.col("positive") > 0) & (F.col("positive") < F.col("valid")))
    return rounded(by.withColumn("weight", G.capped_positive_weight(F.col("positive"), F.col("valid"))))


cte(
    "cohort",
    """SELECT partition_label, year, count(*) AS episodes, count(DISTINCT (year, entity_id)) AS entities, count(DISTINCT facility_id) AS facilities,
  100 * (1 - count(DISTINCT (year, entity_id)) / count(*)::DOUBLE) AS repeat_percent, sum(weight) AS weighted_population,
  sum(weight * age) / sum(weight) AS age_mean, 100 * sum(weight * female) / sum(weight) AS female_percent,
  100 * sum(weight * any_follow_up::INT) / sum(weight) AS any_percent,
  100 * sum(weight * (severity >= 3)::INT) FILTER (WHERE severity IS NOT NULL) / sum(weight) FILTER (WHERE severity IS NOT NULL) AS severe_percent
FROM parts WHERE eligible GROUP BY 1, 2""",
    "parts",
)


def cohort_rows(spark, sf_dir):
    rows = episodes(spark, sf_dir).where("eligible").withColumn("partition_label", partition_label())
    return G.cohort_row(
        rows,
        ["partition_label", "year"],
        ["year", "entity_id"],
        "facility_id",
        "weight",
        {"age_mean": F.col("age")},
        {"female_percent": F.col("female"), "any_percent": F.col("any_follow_up"), "severe_percent": F.col("severity") >= 3},
    )


_PERCENTS = ("repeat_percent", "age_mean", "female_percent", "any_percent", "severe_percent")


@query(
    "cohort_characteristics",
    sql(
        f"""SELECT partition_label, year, episodes, entities, facilities, round(weighted_population, 4) AS weighted_population,
  {', '.join(f'round({c}, 4) AS {c}' for c in _PERCENTS)} FROM cohort""",
        "cohort",
    ),
)
def cohort_characteristics(spark, sf_dir):
    return rounded(cohort_rows(spark, sf_dir), 4)


@query(
    "pooled_cohort",
    sql(
        f"""SELECT sum(episodes)::BIGINT AS episodes, sum(entities)::BIGINT AS entities, sum(facilities)::BIGINT AS facilities,
  round(sum(weighted_population), 4) AS weighted_population, {', '.join(f'round(sum({c} * episodes) / sum(episodes), 4) AS {c}' for c in _PERCENTS)}
FROM cohort WHERE partition_label = 'development'""",
        "cohort",
    ),
)
def pooled_cohort(spark, sf_dir):
    development = cohort_rows(spark, sf_dir).where("partition_label = 'development'")
    pooled = G.pool_rows(
        development, ["episodes", "entities", "facilities", "weighted_population"], skip=["partition_label", "year"]
    )
    return rounded(pooled, 4)


@query(
    "subgroup_size_gate",
    sql(
        """SELECT source, count(*) AS n, sum(y)::BIGINT AS events FROM docs GROUP BY 1
HAVING count(*) >= (SELECT count(*) // 25 FROM docs) AND sum(y) >= 5""",
        "docs",
    ),
)
def subgroup_size_gate(spark, sf_dir):
    rows = scored_documents(spark, sf_dir)
    least = rows.count() // 25
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))
    return by.where((F.col("n") >= least) & (F.col("events") >= 5))


# ranks and capacity ---------------------------------------------------------------------------

@query(
    "capacity_flags",
    sql(
        """SELECT row_id, row_number() OVER (ORDER BY p_tied DESC, row_id) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS flagged FROM uniq""", "uniq"
    ),
)
def capacity_flags(spark, sf_dir):
    flagged, _ = O.capacity_flags(unique_lines(spark, sf_dir), "p_tied", "row_id", 0.2)
    return flagged.select("row_id", "flagged")


@query(
    "capacity_report",
    sql(
        """WITH r AS (SELECT p_tied, row_number() OVER (ORDER BY p_tied DESC, row_id) AS rn, count(*) OVER () AS n FROM uniq),
b AS (SELECT p_tied AS cut, rn AS k FROM r WHERE rn = ceil(0.2::DOUBLE * n))
SELECT k AS capacity_rows, cut AS boundary_score, (SELECT count(*) FROM r WHERE p_tied = cut) AS boundary_ties,
  (SELECT count(*) FROM r WHERE p_tied = cut AND rn <= k) AS boundary_ties_taken FROM b""",
        "uniq",
    ),
)
def capacity_report(spark, sf_dir):
    _, report = O.capacity_flags(unique_lines(spark, sf_dir), "p_tied", "row_id", 0.2)
    return spark.createDataFrame(
        [tuple(report.values())], "capacity_rows bigint, boundary_score double, boundary_ties bigint, boundary_ties_taken bigint"
    )


@query(
    "stable_multi_key_sort",
    sql(
        """SELECT enc_id, row_number() OVER (PARTITION BY year ORDER BY start_day, entity_id, enc_id) AS place FROM enc""", "enc"
    ),
)
def stable_multi_key_sort(spark, sf_dir):
    enc = encounters(spark, sf_dir).select("enc_id", "year", "start_day", "entity_id")
    return O.order_number(enc, ["year"], ["start_day", "entity_id"], "enc_id", "place").select("enc_id", "place")


@query(
    "best_candidate",
    sql(
        """SELECT line_no, source, score FROM (SELECT line_no, 'fine' AS source, round(avg(p_fine), 6) AS score FROM scored GROUP BY 1
UNION ALL SELECT line_no, 'tied', round(avg(p_tied), 6) FROM scored GROUP BY 1) ORDER BY score DESC, source, line_no LIMIT 1""",
        "scored",
    ),
)
def best_candidate(spark, sf_dir):
    by = scored_lines(spark, sf_dir).groupBy("line_no").agg(F.avg("p_fine").alias("fine"), F.avg("p_tied").alias("tied"))
    long = rounded(by.unpivot(["line_no"], ["fine", "tied"], "source", "score"))
    return long.orderBy(F.desc("score"), "source", "line_no").limit(1)


