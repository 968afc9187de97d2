"""Episode linkage, eligibility, windows and history on integer days."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.ids import half_by_parity, hash_bits, nested_half
from strandline.operators import linkage as L
from strandline.operators.aggregates import quality_counts
from strandline.operators.history import history_cells, id_spans, seen_stays, with_history
from strandline.operators.joins import reconcile
from strandline.operators.ordering import order_number
from strandline.operators.skew import crowded
from strandline.plans.bindings import admissions, encoded, encounters
from strandline.plans.registry import cte, query, rnd, sql
from strandline.plans.stages import staged
from strandline.session import materialise
from strandline.sources.readers import read_related

CARRY = ("any_1", "any_2", "any_3")
EVALUATION_YEAR = 2000

cte(
    "gaps",
    """SELECT *, lead(start_day) OVER w AS next_start, lead(start_day) OVER w - start_day - stay AS next_gap
FROM adm WINDOW w AS (PARTITION BY year, entity_id ORDER BY start_day, enc_id)""",
    "adm",
)
cte(
    "idx",
    """SELECT *, (month < 12) AS before_december,
  (dayofyear(last_day(make_date(year, month, 1))) + stay + 30 <= dayofyear(make_date(year, 12, 31))) AS window_fits_year,
  (principal_1 AND age >= 18 AND died = 0 AND disposition NOT IN (2, 20) AND start_day IS NOT NULL AND stay >= 0
   AND month BETWEEN 1 AND 11 AND (next_gap IS NULL OR next_gap >= 1)) AS base_eligible
FROM gaps WHERE any_1 AND age >= 18""",
    "gaps",
)
cte(
    "cand",
    """SELECT i.enc_id,
  min(r.start_day) FILTER (WHERE r.planned_status = 0) AS first_unplanned_day,
  min(r.start_day) FILTER (WHERE r.planned_status = -1) AS first_unknown_day,
  arg_min(r.enc_id, {'d': r.start_day, 'e': r.enc_id}) FILTER (WHERE r.planned_status = 0) AS follow_up_key,
  count(*) FILTER (WHERE r.planned_status = 1) AS planned_follow_ups,
  count(*) FILTER (WHERE r.planned_status = -1) AS unknown_follow_ups
FROM idx i JOIN adm r ON r.year = i.year AND r.entity_id = i.entity_id
 AND r.start_day - i.start_day - i.stay BETWEEN 1 AND 30
GROUP BY i.enc_id""",
    "idx",
)
cte(
    "eps",
    """SELECT *, (base_eligible AND NOT uncertain) AS eligible FROM (
SELECT i.*, c.first_unplanned_day, c.first_unknown_day, c.follow_up_key,
  CASE WHEN c.follow_up_key IS NOT NULL THEN r.start_day - i.start_day - i.stay END AS gap_days,
  coalesce(c.planned_follow_ups, 0) AS planned_follow_ups, coalesce(c.unknown_follow_ups, 0) AS unknown_follow_ups,
  (c.first_unknown_day IS NOT NULL AND (c.first_unplanned_day IS NULL OR c.first_unknown_day <= c.first_unplanned_day)) AS uncertain,
  (c.follow_up_key IS NOT NULL) AS any_follow_up,
  CASE WHEN c.follow_up_key IS NULL THEN 0 ELSE r.cause_code END AS leaf,
  (c.follow_up_key IS NOT NULL AND r.cause_code = 1) AS leaf_1,
  (c.follow_up_key IS NOT NULL AND r.cause_code = 2) AS leaf_2,
  (c.follow_up_key IS NOT NULL AND r.cause_code = 3) AS leaf_3,
  (c.follow_up_key IS NOT NULL AND r.cause_code = 4) AS leaf_4,
  r.any_1 AS follow_up_any_1, r.any_2 AS follow_up_any_2, r.any_3 AS follow_up_any_3
FROM idx i LEFT JOIN cand c USING (enc_id) LEFT JOIN adm r ON r.enc_id = c.follow_up_key)""",
    "cand",
)
cte(
    "parts",
    f"""SELECT *, CASE WHEN year >= {EVALUATION_YEAR}
  THEN CASE WHEN ('0x' || substr(md5(year || ':' || entity_id), 1, 15))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END
  ELSE 'development' END AS partition_label FROM eps""",
    "eps",
)


def index_rule():
    return L.development_rule("principal_1", "age", "died", "disposition")


@staged
def episodes(spark, sf_dir):
    cohort = F.col("any_1") & (F.col("age") >= 18)
    # code arrays are most of a row and stay in their own table, so that linkage does not move them
    adm = admissions(spark, sf_dir).drop("dx", "pr", "prday")
    return L.build_episodes(adm, cohort, index_rule(), carry=CARRY)


def partition_label():
    id_ = hash_bits(F.concat_ws(":", F.col("year").cast("string"), F.col("entity_id").cast("string")))
    return F.when(F.col("year") >= EVALUATION_YEAR, half_by_parity(id_, "A", "B")).otherwise("development")


@query(
    "follow_up_event_rate",
    sql(
        """SELECT partition_label, count(*) AS n_rows, count(*) FILTER (WHERE any_follow_up) AS events,
  round(avg(any_follow_up::INT), 6) AS event_rate
FROM parts WHERE eligible GROUP BY 1""",
        "parts",
    ),
)
def follow_up_event_rate(spark, sf_dir):
    eps = episodes(spark, sf_dir).where("eligible").withColumn("partition_label", partition_label())
    return eps.groupBy("partition_label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("any_follow_up").alias("events"),
        rnd(F.avg(F.col("any_follow_up").cast("double"))).alias("event_rate"),
    )


# windows ----------------------------------------------------------------------

@query("next_gap_by_entity", sql("SELECT enc_id, next_start, next_gap FROM gaps", "gaps"))
def next_gap_by_entity(spark, sf_dir):
    adm = admissions(spark, sf_dir).withColumn("cause", F.col("cause_code"))
    return L.with_next_gap(adm, L.day_cells(adm)).select("enc_id", "next_start", "next_gap")


@query(
    "order_number_by_entity",
    sql(
        "SELECT enc_id, row_number() OVER (PARTITION BY year, entity_id ORDER BY start_day, enc_id) AS order_no FROM enc",
        "enc",
    ),
)
def order_number_by_entity(spark, sf_dir):
    enc = encounters(spark, sf_dir).select("enc_id", "year", "entity_id", "start_day")
    return order_number(enc, ["year", "entity_id"], ["start_day"], "enc_id").select("enc_id", "order_no")


@query(
    "first_episode_by_entity",
    sql(
        """SELECT year, entity_id, min(enc_id) AS first_by_id, arg_min(enc_id, {'d': start_day, 'e': enc_id}) AS first_by_start
FROM eps WHERE eligible GROUP BY 1, 2""",
        "eps",
    ),
)
def first_episode_by_entity(spark, sf_dir):
    return (
        episodes(spark, sf_dir)
        .where("eligible")
        .groupBy("year", "entity_id")
        .agg(
            F.min("enc_id").alias("first_by_id"),
            F.min(F.struct("start_day", "enc_id"))["enc_id"].alias("first_by_start"),
        )
    )


# eligibility --------------------------------------------------------------------

ELIGIBILITY = ("enc_id", "before_december", "window_fits_year", "base_eligible", "uncertain", "eligible")


@query("development_eligibility", sql(f"SELECT {', '.join(ELIGIBILITY)} FROM eps", "eps"))
def development_eligibility(spark, sf_dir):
    return episodes(spark, sf_dir).select(*ELIGIBILITY)


@query(
    "broad_cohort",
    sql("SELECT enc_id, principal_1, principal_2, principal_3 FROM adm WHERE any_1 AND age >= 18", "adm"),
)
def broad_cohort(spark, sf_dir):
    cohort = F.col("any_1") & (F.col("age") >= 18)
    return admissions(spark, sf_dir).where(cohort).select("enc_id", "principal_1", "principal_2", "principal_3")


EPISODE_COLUMNS = (
    "enc_id", "year", "entity_id", "next_gap", "first_unplanned_day", "first_unknown_day", "follow_up_key", "gap_days",
    "planned_follow_ups", "unknown_follow_ups", "uncertain", "any_follow_up", "leaf", "leaf_1", "leaf_2", "leaf_3",
    "leaf_4", "follow_up_any_1", "follow_up_any_2", "follow_up_any_3",
)


@query("episodes", sql(f"SELECT {', '.join(EPISODE_COLUMNS)} FROM eps", "eps"))
def episode_rows(spark, sf_dir):
    return episodes(spark, sf_dir).select(*EPISODE_COLUMNS)


@query(
    "follow_up_summary",
    sql(
        """SELECT i.enc_id, first_unplanned_day, first_unknown_day, follow_up_key, planned_follow_ups, unknown_follow_ups
FROM cand i""",
        "cand",
    ),
)
def follow_up_summary(spark, sf_dir):
    adm = admissions(spark, sf_dir)
    rows = adm.where(F.col("any_1") & (F.col("age") >= 18))
    out = L.with_follow_up(rows, L.day_cells(adm))
    seen = F.col("unplanned").isNotNull() | F.col("first_unknown_day").isNotNull() | (F.col("planned_follow_ups") > 0)
    return out.where(seen).select(
        "enc_id", "first_unplanned_day", "first_unknown_day", "follow_up_key", "planned_follow_ups", "unknown_follow_ups"
    )


QUALITY = {
    "principal": "principal_1",
    "base_eligible": "base_eligible",
    "uncertain": "uncertain",
    "eligible": "eligible",
    "follow_ups": "eligible AND any_follow_up",
    "leaf_1_follow_ups": "eligible AND leaf_1",
    "leaf_2_follow_ups": "eligible AND leaf_2",
    "leaf_3_follow_ups": "eligible AND leaf_3",
    "leaf_4_follow_ups": "eligible AND leaf_4",
    "transferred": "disposition = 2",
    "contiguous": "next_gap <= 0",
    "december": "NOT before_december",
    "window_fits_year": "window_fits_year",
}


@query(
    "episode_quality_counts",
    sql(
        "SELECT year, count(*) AS n_rows, "
        + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in QUALITY.items())
        + " FROM eps GROUP BY 1",
        "eps",
    ),
)
def episode_quality_counts(spark, sf_dir):
    return quality_counts(episodes(spark, sf_dir), {n: F.expr(c) for n, c in QUALITY.items()}, ["year"])


@query(
    "partition_split",
    sql(
        """SELECT partition_label, count(*) AS n_rows, count(DISTINCT (year, entity_id)) AS entities,
  count(DISTINCT facility_id) AS facilities FROM parts GROUP BY 1""",
        "parts",
    ),
)
def partition_split(spark, sf_dir):
    eps = episodes(spark, sf_dir).withColumn("partition_label", partition_label())
    return eps.groupBy("partition_label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("year", "entity_id").alias("entities"),
        F.countDistinct("facility_id").alias("facilities"),
    )


@query(
    "nested_calibration_split",
    sql(
        """SELECT enc_id, ((('0x' || substr(md5(year || ':' || entity_id), 1, 15))::BIGINT >> 1) & 1)::INT AS half
FROM eps WHERE eligible""",
        "eps",
    ),
)
def nested_calibration_split(spark, sf_dir):
    id_ = hash_bits(F.concat_ws(":", F.col("year").cast("string"), F.col("entity_id").cast("string")))
    return episodes(spark, sf_dir).where("eligible").select("enc_id", nested_half(id_).alias("half"))


# evaluation rule on text columns ------------------------------------------------

cte(
    "texts",
    """SELECT * EXCLUDE (start_day, stay),
  CASE WHEN enc_id % 97 = 0 THEN 'n/a' ELSE start_day::VARCHAR END AS start_day,
  CASE WHEN enc_id % 89 = 0 THEN '' WHEN enc_id % 31 = 0 THEN '-1' ELSE stay::VARCHAR END AS stay FROM adm""",
    "adm",
)
cte(
    "nums",
    "SELECT * EXCLUDE (start_day, stay), try_cast(start_day AS INT) AS start_day, try_cast(stay AS INT) AS stay FROM texts",
    "texts",
)
cte(
    "later",
    """SELECT *, lead(start_day) OVER (PARTITION BY year, entity_id ORDER BY start_day NULLS LAST, enc_id)
   - start_day - greatest(stay, 0) AS next_gap FROM nums""",
    "nums",
)
cte(
    "base_eval",
    """SELECT * FROM later WHERE principal_1 AND start_day IS NOT NULL AND stay IS NOT NULL AND age >= 18 AND died = 0
  AND disposition NOT IN (2, 20) AND month <= 11 AND (next_gap IS NULL OR next_gap >= 1)""",
    "later",
)
cte(
    "eval_cand",
    """SELECT i.enc_id, min(r.start_day) FILTER (WHERE r.planned_status = 0) AS u,
  min(r.start_day) FILTER (WHERE r.planned_status = -1) AS x,
  arg_min(r.cause_code, {'d': r.start_day, 'e': r.enc_id}) FILTER (WHERE r.planned_status = 0) AS cause
FROM base_eval i LEFT JOIN nums r ON r.year = i.year AND r.entity_id = i.entity_id
 AND r.start_day - i.start_day - greatest(i.stay, 0) BETWEEN 1 AND 30 GROUP BY 1""",
    "base_eval",
    "nums",
)
cte(
    "repaired",
    """SELECT enc_id, (u IS NOT NULL)::INT AS any_follow_up, coalesce(cause, 0) AS leaf
FROM eval_cand WHERE NOT (x IS NOT NULL AND (u IS NULL OR x <= u))""",
    "eval_cand",
)
cte(
    "broken",
    """SELECT enc_id, (u IS NOT NULL)::INT AS any_follow_up, coalesce(cause, 0) AS leaf
FROM eval_cand WHERE NOT (coalesce(x, 1000000000) <= coalesce(u, 1000000000))""",
    "eval_cand",
)


def text_admissions(spark, sf_dir):
    """Admissions whose day and stay came as text, some of it unreadable."""
    key = F.col("enc_id")
    return admissions(spark, sf_dir).withColumns(
        {
            "start_day": F.when(F.pmod(key, F.lit(97)) == 0, "n/a").otherwise(F.col("start_day").cast("string")),
            "stay": F.when(F.pmod(key, F.lit(89)) == 0, "")
            .when(F.pmod(key, F.lit(31)) == 0, "-1")
            .otherwise(F.col("stay").cast("string")),
        }
    )


@staged
def evaluation_base(spark, sf_dir):
    adm = L.numeric_days(text_admissions(spark, sf_dir))
    rule = L.evaluation_rule("principal_1", "age", "died", "disposition")
    usable = F.col("principal_1") & F.col("start_day").isNotNull() & F.col("stay").isNotNull()
    return L.build_episodes(adm, usable, rule, clip=True).where("base_eligible")


@query("evaluation_episodes", sql("SELECT * FROM repaired", "repaired"))
def evaluation_episodes(spark, sf_dir):
    rows = evaluation_base(spark, sf_dir).where(~F.col("uncertain"))
    return rows.select("enc_id", F.col("any_follow_up").cast("int").alias("any_follow_up"), "leaf")


@query(
    "repair_comparison",
    sql(
        """SELECT (SELECT count(*) FROM broken) AS broken_n, (SELECT count(*) FROM repaired) AS repaired_n,
  (SELECT count(*) FROM repaired r WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.enc_id = r.enc_id)) AS restored_n,
  (SELECT count(*) FROM repaired r WHERE any_follow_up = 0
     AND NOT EXISTS (SELECT 1 FROM broken b WHERE b.enc_id = r.enc_id)) AS restored_negatives,
  (SELECT count(*) FROM repaired r JOIN broken b USING (enc_id) WHERE r.leaf <> b.leaf) AS leaf_changes""",
        "broken",
        "repaired",
    ),
)
def repair_comparison(spark, sf_dir):
    """The rule that read missing days as infinity, against the one that does not."""
    base = evaluation_base(spark, sf_dir)
    far = F.lit(1_000_000_000)
    dropped = F.coalesce("first_unknown_day", far) <= F.coalesce("first_unplanned_day", far)
    broken = base.where(~dropped).select("enc_id", F.col("leaf").alias("old_leaf"))
    both = base.where(~F.col("uncertain")).join(broken, "enc_id", "full_outer")
    old, new = F.col("old_leaf").isNotNull(), F.col("leaf").isNotNull()
    return both.agg(
        F.count_if(old).alias("broken_n"),
        F.count_if(new).alias("repaired_n"),
        F.count_if(new & ~old).alias("restored_n"),
        F.count_if(new & ~old & ~F.col("any_follow_up")).alias("restored_negatives"),
        F.count_if(new & old & (F.col("leaf") != F.col("old_leaf"))).alias("leaf_changes"),
    )


# independent rebuild --------------------------------------------------------------

REACH = 30  # days after a stay in which a follow-up starts


def rebuild(spark, sf_dir):
    """The same cohort by another way: rows joined to their successor by order
    number, and each end day to the cells of the two buckets of days it reaches into.

    The sizes of these joins do not show in the files they are read from, so none is
    left to be broadcast.
    """
    adm = admissions(spark, sf_dir)
    keys = ["year", "entity_id"]
    slim = adm.select(*keys, "enc_id", "start_day")
    numbered = materialise(order_number(slim, keys, ["start_day"], "enc_id"), "numbered")
    successor = numbered.select(*keys, (F.col("order_no") - 1).alias("order_no"), F.col("start_day").alias("_next"))
    gap = F.col("_next") - F.col("start_day") - F.greatest("stay", F.lit(0))
    base = (
        adm.where("principal_1 AND age >= 18 AND died = 0 AND disposition NOT IN (2, 20) AND stay >= 0 AND month BETWEEN 1 AND 11")
        .select(*keys, "enc_id", "start_day", "stay")
        .join(numbered.select("enc_id", "order_no").hint("merge"), "enc_id")
        .join(successor.hint("merge"), [*keys, "order_no"], "left")
        .where(gap.isNull() | (gap >= 1))
        .select(*keys, "enc_id", (F.col("start_day") + F.greatest("stay", F.lit(0))).alias("end_day"))
    )
    base = materialise(base, "base")
    status = F.col("planned_status")
    days = adm.groupBy(*keys, "start_day").agg(
        F.min(F.when(status == 0, F.struct("start_day", "enc_id", "cause_code"))).alias("u"),
        F.min(F.when(status == -1, F.col("start_day"))).alias("x"),
    )
    bucket = lambda day: F.floor(day / F.lit(REACH)).alias("_bucket")
    days = days.where("u IS NOT NULL OR x IS NOT NULL").select(*keys, "start_day", bucket(F.col("start_day")), "u", "x")
    ends = base.select(*keys, "end_day").distinct()
    reach = F.array_distinct(F.array(bucket(F.col("end_day") + 1), bucket(F.col("end_day") + REACH)))
    ends = ends.withColumn("_bucket", F.explode(reach))
    ahead = ends.join(days.hint("merge"), [*keys, "_bucket"]).where(F.col("start_day").between(F.col("end_day") + 1, F.col("end_day") + REACH))
    ahead = ahead.groupBy(*keys, "end_day").agg(F.min("u").alias("u"), F.min("x").alias("x"))
    found = base.join(ahead.hint("merge"), [*keys, "end_day"], "left")
    return found.where("x IS NULL OR (u IS NOT NULL AND x > u.start_day)").select(
        "year",
        "enc_id",
        F.col("u").isNotNull().cast("int").alias("y_any"),
        F.coalesce(F.col("u.cause_code") == 1, F.lit(False)).cast("int").alias("y_1"),
    )


def published(spark, sf_dir):
    return episodes(spark, sf_dir).where("eligible").select(
        "year", "enc_id", F.col("any_follow_up").cast("int").alias("y_any"), F.col("leaf_1").cast("int").alias("y_1")
    )


@query(
    "cohort_rebuild",
    sql(
        """SELECT year, count(*) AS rebuilt_n, sum(any_follow_up::INT)::BIGINT AS any_events, sum(leaf_1::INT)::BIGINT AS leaf_1_events
FROM eps WHERE eligible GROUP BY 1""",
        "eps",
    ),
)
def cohort_rebuild(spark, sf_dir):
    return rebuild(spark, sf_dir).groupBy("year").agg(
        F.count(F.lit(1)).alias("rebuilt_n"), F.sum("y_any").alias("any_events"), F.sum("y_1").alias("leaf_1_events")
    )


@query(
    "cohort_reconciliation",
    sql(
        """SELECT count(*) FILTER (WHERE eligible) AS left_n, count(*) FILTER (WHERE eligible) AS right_n,
  0::BIGINT AS key_mismatch_n, 0::BIGINT AS label_mismatch_n FROM eps""",
        "eps",
    ),
)
def cohort_reconciliation(spark, sf_dir):
    return reconcile(rebuild(spark, sf_dir), published(spark, sf_dir), ["enc_id"], ["y_any", "y_1"])


@query(
    "amended_reconciliation",
    sql(
        """WITH a AS (SELECT enc_id, any_follow_up::INT AS y_any, leaf_1::INT AS y_1 FROM eps WHERE eligible),
b AS (SELECT enc_id, CASE WHEN enc_id % 13 = 0 THEN 1 - y_any ELSE y_any END AS y_any, CASE WHEN enc_id % 17 <> 0 THEN y_1 END AS y_1 FROM a WHERE enc_id % 11 <> 0
  UNION ALL SELECT -enc_id, y_any, y_1 FROM a WHERE enc_id % 19 = 5)
SELECT (SELECT count(*) FROM a) AS left_n, (SELECT count(*) FROM b) AS right_n,
  (SELECT count(*) FROM a ANTI JOIN b USING (enc_id)) + (SELECT count(*) FROM b ANTI JOIN a USING (enc_id)) AS key_mismatch_n,
  (SELECT count(*) FROM a JOIN b USING (enc_id) WHERE a.y_any IS DISTINCT FROM b.y_any OR a.y_1 IS DISTINCT FROM b.y_1) AS label_mismatch_n""",
        "eps",
    ),
)
def amended_reconciliation(spark, sf_dir):
    """A cohort against an amended one: rows gone, rows new, labels turned and labels lost."""
    ours, key = published(spark, sf_dir).select("enc_id", "y_any", "y_1"), F.col("enc_id")
    turned = F.when(key % 13 == 0, 1 - F.col("y_any")).otherwise(F.col("y_any"))
    kept = ours.where(key % 11 != 0).withColumns({"y_any": turned, "y_1": F.when(key % 17 != 0, F.col("y_1"))})
    more = ours.where(key % 19 == 5).withColumn("enc_id", -key)
    return reconcile(ours, kept.unionByName(more), ["enc_id"], ["y_any", "y_1"])


@query(
    "related_entity_rows",
    sql(
        """SELECT enc_id FROM adm a WHERE EXISTS
  (SELECT 1 FROM adm p WHERE p.principal_1 AND p.year = a.year AND p.entity_id = a.entity_id)""",
        "adm",
    ),
)
def related_entity_rows(spark, sf_dir):
    adm = admissions(spark, sf_dir)
    return read_related(adm, adm.where("principal_1"), ["year", "entity_id"]).select("enc_id")


# history --------------------------------------------------------------------------

cte(
    "hist",
    """SELECT i.enc_id, count(r.enc_id) AS prior_count_ytd,
  count(r.enc_id) FILTER (WHERE gap <= 30) AS prior_count_30d, count(r.enc_id) FILTER (WHERE gap <= 90) AS prior_count_90d,
  count(r.enc_id) FILTER (WHERE gap <= 180) AS prior_count_180d,
  count(r.enc_id) FILTER (WHERE gap <= 180 AND r.emergency > 0) AS prior_emergency_180d,
  count(r.enc_id) FILTER (WHERE gap <= 180 AND coalesce(r.elective, 0) <> 1) AS prior_nonelective_180d,
  coalesce(sum(r.stay) FILTER (WHERE gap <= 180), 0)::BIGINT AS prior_stay_sum_180d,
  count(r.enc_id) FILTER (WHERE gap <= 180 AND r.principal_1) AS prior_principal_1_180d,
  count(r.enc_id) FILTER (WHERE gap <= 180 AND r.principal_2) AS prior_principal_2_180d,
  count(r.enc_id) FILTER (WHERE gap <= 180 AND r.principal_3) AS prior_principal_3_180d,
  coalesce(max(r.severity) FILTER (WHERE gap <= 180), 0) AS prior_max_severity_180d,
  coalesce(max(r.risk) FILTER (WHERE gap <= 180), 0) AS prior_max_risk_180d,
  coalesce(min(gap), -1) AS days_since_prior,
  list_sort(list_distinct(coalesce(flatten(list(list_filter(r.dx_ids, lambda x: x > 3)) FILTER (WHERE gap <= 180)), []::INT[]))) AS prior_dx_ids_180d,
  list_sort(list_distinct(coalesce(flatten(list(list_filter(r.pr_ids, lambda x: x > 3)) FILTER (WHERE gap <= 180)), []::INT[]))) AS prior_pr_ids_180d,
  any_value(i.month) >= 2 AS seen_30d, any_value(i.month) >= 4 AS seen_90d, any_value(i.month) >= 7 AS seen_180d
FROM eps i LEFT JOIN (SELECT * FROM encoded) r ON r.year = i.year AND r.entity_id = i.entity_id
  AND r.start_day < i.start_day AND r.start_day + greatest(coalesce(r.stay, 0), 0) <= i.start_day
LEFT JOIN LATERAL (SELECT i.start_day - (r.start_day + greatest(coalesce(r.stay, 0), 0)) AS gap) g ON true
WHERE i.eligible GROUP BY i.enc_id""",
    "eps",
    "encoded",
)
CAUSES = ("principal_1", "principal_2", "principal_3")
SEVERITIES = ("severity", "risk")
HISTORY = (
    "prior_count_ytd", "prior_count_30d", "prior_count_90d", "prior_count_180d", "prior_emergency_180d",
    "prior_nonelective_180d", "prior_stay_sum_180d", "prior_principal_1_180d", "prior_principal_2_180d",
    "prior_principal_3_180d", "prior_max_severity_180d", "prior_max_risk_180d", "days_since_prior",
    "seen_30d", "seen_90d", "seen_180d",
)
BAGS = ("prior_dx_ids_180d", "prior_pr_ids_180d")


@staged
def histories(spark, sf_dir):
    adm, codes = encoded(spark, sf_dir), ("dx_ids", "pr_ids")
    cells = materialise(history_cells(adm, "emergency", "elective", CAUSES, SEVERITIES), "history_cells")
    index = episodes(spark, sf_dir).where("eligible")
    crowd = cells.groupBy("year", "entity_id").agg(F.sum("n").alias("n")) if crowded(cells, ["year", "entity_id"]) else None
    stays = seen_stays(adm.select("year", "entity_id", "start_day", "stay", *codes), index, crowd)
    return with_history(index, cells, id_spans(stays, codes, dealt=crowd is None), CAUSES, SEVERITIES, codes, crowd=crowd is not None).select(
        "enc_id", "year", "entity_id", *HISTORY, *BAGS
    )


@query("history_days", sql(f"SELECT enc_id, {', '.join(HISTORY)} FROM hist", "hist"))
def history_days(spark, sf_dir):
    return histories(spark, sf_dir).select("enc_id", *HISTORY)


@query("history_code_bags", sql(f"SELECT enc_id, {', '.join(BAGS)} FROM hist", "hist"))
def history_code_bags(spark, sf_dir):
    return histories(spark, sf_dir).select("enc_id", *BAGS)
