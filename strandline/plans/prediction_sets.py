"""Prediction sets, drift against a frozen profile, and disclosure control."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.values import wilson_effective
from strandline.operators import conformal as P
from strandline.operators import disclosure as X
from strandline.operators import drift as D
from strandline.operators import metrics as M
from strandline.operators import resample as S
from strandline.plans.bindings import class_scores, encounters, scored_lines
from strandline.plans.evaluation import PAIRS, entity_draws, metrics_sql, newton_sql, tidy
from strandline.plans.linkage import episodes, partition_label
from strandline.plans.registry import cte, query, rnd, rounded, sql
from strandline.plans.stages import staged
from strandline.session import materialise

ALPHAS = (0.1, 0.2, 0.05)
MIN_ROWS = 145
DIMENSIONS = {"sex": "sex", "band": "band"}
NAMES = ("none", "ap", "biliary", "sepsis_or_organ", "other")

cte(
    "probs",
    """SELECT *, [s0 / t, s1 / t, s2 / t, s3 / t, s4 / t] AS probs, 1 - ([s0, s1, s2, s3, s4][y + 1]) / t AS score
FROM (SELECT *, s0 + s1 + s2 + s3 + s4 AS t FROM classes)""",
    "classes",
)
cte(
    "cal_long",
    """SELECT 'ALL' AS dimension, 'ALL' AS level, score FROM probs UNION ALL SELECT 'sex', sex, score FROM probs UNION ALL SELECT 'band', band, score FROM probs""",
    "probs",
)
cte(
    "raw_q",
    f"""SELECT dimension, level, alpha, count(*) AS n,
  list(score ORDER BY score)[least(count(*), ceil((count(*) + 1) * (1.0::DOUBLE - alpha))::BIGINT)] AS q
FROM cal_long, (SELECT unnest([{', '.join(map(str, ALPHAS))}])::DOUBLE AS alpha) GROUP BY 1, 2, 3""",
    "cal_long",
)
cte(
    "cutoffs",
    f"""SELECT r.dimension, r.level, r.alpha, r.n, CASE WHEN r.n < {MIN_ROWS} AND r.dimension <> 'ALL' THEN g.q ELSE r.q END AS q,
  CASE WHEN r.n < {MIN_ROWS} AND r.dimension <> 'ALL' THEN 'GLOBAL_FALLBACK_SMALL_CALIBRATION_GROUP' ELSE 'CALIBRATED' END AS status
FROM raw_q r JOIN raw_q g ON g.dimension = 'ALL' AND g.alpha = r.alpha""",
    "raw_q",
)


def _mask_sql(q: str) -> str:
    bits = " + ".join(f"(probs[{k + 1}] >= 1 - {q})::INT * {1 << k}" for k in range(5))
    return f"(CASE WHEN {bits} > 0 THEN {bits} ELSE 1 << (list_position(probs, list_max(probs)) - 1)::INT END)::INT"


cte(
    "sets",
    f"""SELECT p.*, {_mask_sql('g.q')} AS mask_all, {_mask_sql('s.q')} AS mask_sex, {_mask_sql('b.q')} AS mask_band FROM probs p
JOIN cutoffs g ON g.dimension = 'ALL' AND g.alpha = 0.1 JOIN cutoffs s ON s.dimension = 'sex' AND s.level = p.sex AND s.alpha = 0.1
JOIN cutoffs b ON b.dimension = 'band' AND b.level = p.band AND b.alpha = 0.1""",
    "probs",
    "cutoffs",
)
cte(
    "decided",
    """SELECT *, NOT (bit_count(mask_all) = 1 AND NOT conflict) AS abstain FROM (SELECT *,
  ((mask_all & 1) = 1 AND p_any >= 0.8) OR ((mask_all & 1) = 0 AND p_any < 0.8) AS conflict FROM sets)""",
    "sets",
)


def scored_classes(spark, sf_dir):
    rows = class_scores(spark, sf_dir)
    probs = P.normalise_scores([F.col(f"s{k}") for k in range(5)])
    rows = rows.withColumn("probs", probs)
    return rows.withColumn("score", P.nonconformity(F.col("probs"), F.col("y").cast("int")))


@staged
def class_cutoffs(spark, sf_dir):
    dimensions = {d: F.col(c) for d, c in DIMENSIONS.items()}
    return P.cutoffs(scored_classes(spark, sf_dir), "score", dimensions, ALPHAS, MIN_ROWS)


@staged
def class_sets(spark, sf_dir):
    rows, cut = scored_classes(spark, sf_dir), class_cutoffs(spark, sf_dir)
    rows = P.with_sets(rows, "probs", cut, P.GLOBAL, F.lit(P.GLOBAL), 0.1, "mask_all")
    rows = P.with_sets(rows, "probs", cut, "sex", F.col("sex"), 0.1, "mask_sex")
    rows = P.with_sets(rows, "probs", cut, "band", F.col("band"), 0.1, "mask_band")
    abstain, conflict = P.abstains(F.col("mask_all"), F.col("p_any"), 0.8)
    return rows.withColumns({"conflict": conflict, "abstain": abstain})


@query(
    "normalised_scores",
    sql("SELECT vec_id, list_transform(probs, lambda x: round(x, 6)) AS probs, round(score, 6) AS score FROM probs", "probs"),
)
def normalised_scores(spark, sf_dir):
    rows = scored_classes(spark, sf_dir)
    return rows.select("vec_id", F.transform("probs", lambda x: rnd(x)).alias("probs"), rnd(F.col("score")).alias("score"))


@query(
    "conformal_cutoffs",
    sql("SELECT dimension, level, alpha, n, round(q, 6) AS q, status FROM cutoffs", "cutoffs"),
)
def conformal_cutoffs(spark, sf_dir):
    return rounded(class_cutoffs(spark, sf_dir), 6, "q")


@query(
    "cutoff_projection",
    sql("SELECT dimension, level, alpha, round(q, 6) AS q FROM cutoffs WHERE dimension IN ('ALL', 'sex')", "cutoffs"),
)
def cutoff_projection(spark, sf_dir):
    kept = P.project_cutoffs(class_cutoffs(spark, sf_dir), ["sex"])
    return rounded(kept.select("dimension", "level", "alpha", "q"), 6, "q")


@query(
    "conformal_sets",
    sql(
        """SELECT vec_id, mask_all, mask_sex, mask_band, bit_count(mask_all)::INT AS set_size, (mask_all & 30) <> 0 AS includes_parent,
  CASE WHEN bit_count(mask_all) = 1 THEN log2(mask_all)::INT END AS single_class, (mask_all >> y) & 1 = 1 AS covered, conflict, abstain FROM decided""",
        "decided",
    ),
)
def conformal_sets(spark, sf_dir):
    rows = class_sets(spark, sf_dir)
    extra = P.set_columns(F.col("mask_all"), F.col("y"))
    return rows.select(
        "vec_id", "mask_all", "mask_sex", "mask_band", *[c.alias(n) for n, c in extra.items()], "conflict", "abstain"
    )


_TIER = """CASE WHEN event_count >= 100 THEN 'CONFIRMATORY_GE_100_EVENTS' WHEN event_count >= 50 THEN 'EXPLORATORY_50_TO_99_EVENTS' ELSE 'DESCRIPTIVE_LT_50_EVENTS' END"""


def coverage_sql(source: str, groups: str, mask: str, abstain: str) -> str:
    lead = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {lead}n_rows, event_count, round(mean_set_size, 6) AS mean_set_size, median_set_size, round(singleton_rate, 6) AS singleton_rate,
  round(empty_set_rate, 6) AS empty_set_rate, round(full_set_rate, 6) AS full_set_rate, round(abstention_rate, 6) AS abstention_rate,
  round(retained_event_rate, 6) AS retained_event_rate, round(abstained_event_rate, 6) AS abstained_event_rate,
  round(retained_error_rate, 6) AS retained_error_rate, round(abstained_set_error_rate, 6) AS abstained_set_error_rate,
  round(k / n_rows::DOUBLE, 6) AS coverage,
  round(greatest(0, (k / n_rows::DOUBLE + z * z / (2 * n_rows)) / (1 + z * z / n_rows) - z * sqrt((k / n_rows::DOUBLE * (1 - k / n_rows::DOUBLE) + z * z / (4 * n_rows)) / n_rows) / (1 + z * z / n_rows)), 6) AS coverage_low,
  round(least(1, (k / n_rows::DOUBLE + z * z / (2 * n_rows)) / (1 + z * z / n_rows) + z * sqrt((k / n_rows::DOUBLE * (1 - k / n_rows::DOUBLE) + z * z / (4 * n_rows)) / n_rows) / (1 + z * z / n_rows)), 6) AS coverage_high,
  {_TIER} AS event_tier
FROM (SELECT {lead}count(*) AS n_rows, sum(e)::BIGINT AS event_count, sum(c) AS k, avg(sz) AS mean_set_size, median(sz)::DOUBLE AS median_set_size,
  avg((sz = 1)::INT) AS singleton_rate, avg((sz = 0)::INT) AS empty_set_rate, avg((sz = 5)::INT) AS full_set_rate, avg(a) AS abstention_rate,
  avg(e) FILTER (WHERE a = 0) AS retained_event_rate, avg(e) FILTER (WHERE a = 1) AS abstained_event_rate,
  avg(w) FILTER (WHERE a = 0) AS retained_error_rate, avg(1 - c) FILTER (WHERE a = 1) AS abstained_set_error_rate, 1.959963984540054::DOUBLE AS z
  FROM (SELECT *, bit_count({mask}) AS sz, (({mask} >> y) & 1)::INT AS c, (y <> 0)::INT AS e, ({abstain})::INT AS a,
          (NOT (bit_count({mask}) = 1 AND {mask} = (1 << y)))::INT AS w FROM {source}) {by})"""


@query("coverage_summary", sql(coverage_sql("decided", "", "mask_all", "abstain"), "decided"))
def coverage_summary(spark, sf_dir):
    return rounded(P.coverage_summary(class_sets(spark, sf_dir), [], "mask_all", "y", "abstain"))


_SUB = "(SELECT *, 'sex' AS dimension, sex AS level FROM decided UNION ALL SELECT *, 'band', band FROM decided)"


@query("coverage_by_subgroup", sql(coverage_sql(_SUB, "dimension, level", "mask_sex", "bit_count(mask_sex) <> 1"), "decided"))
def coverage_by_subgroup(spark, sf_dir):
    dimensions = {d: F.col(c) for d, c in DIMENSIONS.items()}
    return rounded(P.coverage_by_subgroup(class_sets(spark, sf_dir), [], dimensions, "mask_sex", "y"))


LABEL_NAMES = {f"label_{k}": n for k, n in enumerate(NAMES)}


@query(
    "named_set_coverage",
    sql(
        """SELECT sex, count(*) AS n, count(*) FILTER (WHERE y <> 0) AS target_events, round(avg(((mask_sex >> y) & 1)::INT), 6) AS coverage,
  round(avg(bit_count(mask_sex)), 6) AS mean_set_size, round(avg((bit_count(mask_sex) <> 1)::INT), 6) AS abstention_rate FROM sets GROUP BY 1""",
        "sets",
    ),
)
def named_set_coverage(spark, sf_dir):
    """Sets read from a nested map, as class names, against labels of another naming."""
    rows = class_sets(spark, sf_dir)
    members = F.filter(
        F.array(*[F.when(F.getbit(F.col("mask_sex").cast("long"), F.lit(k)) == 1, F.lit(n)) for k, n in enumerate(NAMES)]),
        lambda c: c.isNotNull(),
    )
    record = F.struct(members.alias("set"), (F.bit_count("mask_sex") != 1).alias("abstain"))
    nested = rows.select(
        "sex",
        F.concat(F.lit("label_"), F.col("y").cast("string")).alias("label"),
        F.create_map(F.lit("90"), F.create_map(F.lit("sex"), record)).alias("conformal"),
    )
    found = F.col("conformal")["90"]["sex"]
    return rounded(P.named_set_coverage(nested, ["sex"], found["set"], F.col("label"), LABEL_NAMES, found["abstain"]))


@query(
    "singleton_risk_coverage",
    sql(
        "SELECT m.*, round(n_rows / (SELECT count(*) FROM decided)::DOUBLE, 6) AS coverage_fraction FROM ("
        + metrics_sql("(SELECT (y <> 0)::INT AS y, p_any AS p FROM decided WHERE bit_count(mask_all) = 1)", "", "1.0::DOUBLE")
        + ") m",
        "decided",
    ),
)
def singleton_risk_coverage(spark, sf_dir):
    """Metrics among rows with a single-class set, with their share."""
    rows = class_sets(spark, sf_dir).withColumn("event", (F.col("y") != 0).cast("int"))
    total = rows.count()
    kept = rows.where(F.bit_count("mask_all") == 1)
    out = M.binary_metrics(kept, [], "p_any", "event")
    return tidy(out.withColumn("coverage_fraction", F.col("n_rows") / F.lit(float(total))))


# drift ---------------------------------------------------------------------------------

EDGES = (15.0, 35.0, 55.0, 75.0, 90.0)
_AGE_BIN = "CASE WHEN age >= 15 AND age < 35 THEN '[15,35)' WHEN age >= 35 AND age < 55 THEN '[35,55)' WHEN age >= 55 AND age < 75 THEN '[55,75)' WHEN age >= 75 AND age <= 90 THEN '[75,90]' ELSE '<NONFINITE_OR_OUT_OF_RANGE>' END"
cte(
    "levels",
    """SELECT * FROM (VALUES ('age', 'age', 'numeric_binned', '[15,35)'), ('age', 'age', 'numeric_binned', '[35,55)'), ('age', 'age', 'numeric_binned', '[55,75)'),
  ('age', 'age', 'numeric_binned', '[75,90]'), ('age', 'age', 'numeric_binned', '<NONFINITE_OR_OUT_OF_RANGE>'),
  ('payer', 'payer', 'categorical', '<UNSEEN_OR_OTHER>')) v(covariate, source_column, kind, level)
UNION ALL SELECT DISTINCT 'payer', 'payer', 'categorical', payer::VARCHAR FROM enc WHERE year <= 1998 AND payer IS NOT NULL""",
    "enc",
)
for _name, _where in (("ref", "year <= 1998"), ("obs", "year > 1998")):
    cte(
        f"{_name}_rows",
        f"""SELECT 'age' AS covariate, {_AGE_BIN} AS level, weight AS w, age::DOUBLE AS v, age IS NULL AS missing FROM enc WHERE {_where}
UNION ALL SELECT 'payer', coalesce(payer::VARCHAR, '<UNSEEN_OR_OTHER>'), weight, NULL, payer IS NULL FROM enc WHERE {_where}""",
        "enc",
    )
    cte(
        f"{_name}_profile",
        f"""SELECT l.*, coalesce(s.w / t.w, 0.0::DOUBLE) AS share, t.missing_rate, t.mu AS weighted_mean, t.sd AS weighted_sd FROM levels l
LEFT JOIN (SELECT covariate, level, sum(w) AS w FROM {_name}_rows GROUP BY 1, 2) s USING (covariate, level)
JOIN (SELECT covariate, sum(w) AS w, avg(missing::INT) AS missing_rate, sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL) AS mu,
   sqrt(sum(w * v * v) / sum(w) FILTER (WHERE v IS NOT NULL) - (sum(w * v) / sum(w) FILTER (WHERE v IS NOT NULL)) ** 2) AS sd FROM {_name}_rows GROUP BY 1) t USING (covariate)""",
        "levels",
        f"{_name}_rows",
    )


def covariates(spark, sf_dir):
    development = encounters(spark, sf_dir).where("year <= 1998")
    return [
        D.Covariate("age", "age", edges=EDGES),
        D.Covariate("payer", "payer", levels=D.frozen_levels(development, "payer")),
    ]


def profiles(spark, sf_dir):
    enc, watched = encounters(spark, sf_dir), covariates(spark, sf_dir)
    return D.profile(enc.where("year <= 1998"), watched, "weight"), D.profile(enc.where("year > 1998"), watched, "weight")


@query(
    "reference_profile",
    sql(
        """SELECT covariate, source_column, kind, level, round(share, 6) AS share, round(missing_rate, 6) AS missing_rate, round(weighted_mean, 6) AS weighted_mean,
  round(weighted_sd, 6) AS weighted_sd FROM ref_profile""",
        "ref_profile",
    ),
)
def reference_profile(spark, sf_dir):
    return rounded(profiles(spark, sf_dir)[0].drop("level_no"))


@query(
    "covariate_drift",
    sql(
        """SELECT covariate, source_column, kind, level, round(r.share, 6) AS reference_share, round(o.share, 6) AS observed_share, round(o.share - r.share, 6) + 0.0 AS share_change,
  round(sum((o.share - r.share) * ln((o.share + 1e-12::DOUBLE) / (r.share + 1e-12::DOUBLE))) OVER (PARTITION BY covariate), 6) AS population_stability_index,
  round(r.missing_rate, 6) AS reference_missing_rate, round(o.missing_rate, 6) AS observed_missing_rate, round(o.missing_rate - r.missing_rate, 6) + 0.0 AS missing_rate_change,
  round(o.weighted_mean, 6) AS observed_weighted_mean, round(o.weighted_sd, 6) AS observed_weighted_sd,
  round((o.weighted_mean - r.weighted_mean) / r.weighted_sd, 6) + 0.0 AS standardized_mean_difference
FROM obs_profile o JOIN ref_profile r USING (covariate, source_column, kind, level)""",
        "obs_profile",
        "ref_profile",
    ),
)
def covariate_drift(spark, sf_dir):
    reference, observed = profiles(spark, sf_dir)
    return rounded(D.covariate_drift(observed, reference))


OUTCOMES = ("death", "long_stay", "high_cost")
cte(
    "labels_long",
    """SELECT year > 1998 AS late, weight AS w, outcome, y FROM (SELECT *, 'death' AS outcome, died AS y FROM enc UNION ALL SELECT *, 'long_stay', (stay > 5)::INT FROM enc
  UNION ALL SELECT *, 'high_cost', CASE WHEN entity_id % 9 > 0 THEN (charge > 300000)::INT END FROM enc)""",
    "enc",
)
cte(
    "label_sums",
    """SELECT late, outcome, count(y) AS valid_n, count(*) FILTER (WHERE y IS NULL) AS missing_n, sum(y)::BIGINT AS event_count, sum(w) FILTER (WHERE y IS NOT NULL) AS valid_weight,
  sum(w * w) FILTER (WHERE y IS NOT NULL) AS ww, sum(w * y) AS wy FROM labels_long GROUP BY 1, 2""",
    "labels_long",
)
cte(
    "rates",
    """SELECT *, 1.959963984540054::DOUBLE AS z FROM (
 SELECT late, outcome, valid_n, missing_n, event_count, valid_weight, 'unweighted_rate' AS weighting, event_count / valid_n::DOUBLE AS rate, event_count::DOUBLE AS k, valid_n::DOUBLE AS n FROM label_sums
 UNION ALL SELECT late, outcome, valid_n, missing_n, event_count, valid_weight, 'weighted_rate', wy / valid_weight, round_even(wy / valid_weight * (valid_weight * valid_weight / ww), 0),
   round_even(valid_weight * valid_weight / ww, 0) FROM label_sums)""",
    "label_sums",
)
cte(
    "rates_ci",
    f"""SELECT *, greatest(0, (k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n) / (1 + z * z / n)) AS ci_low,
  least(1, (k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n) / (1 + z * z / n)) AS ci_high, {_TIER} AS event_tier FROM rates""",
    "rates",
)


def label_rows(spark, sf_dir, late: bool):
    enc = encounters(spark, sf_dir).where("year > 1998" if late else "year <= 1998")
    enc = enc.select(
        "weight",
        F.col("died").alias("death"),
        (F.col("stay") > 5).cast("int").alias("long_stay"),
        F.when(F.pmod("entity_id", F.lit(9)) > 0, (F.col("charge") > 300000).cast("int")).alias("high_cost"),
    )
    return D.labels_long(enc, OUTCOMES, ["weight"], nullable=["high_cost"])


@query(
    "label_drift",
    sql(
        """SELECT o.outcome, o.valid_n, o.missing_n, o.event_count, round(o.valid_weight, 4) AS valid_weight, o.event_tier, o.weighting, round(o.rate, 6) AS rate,
  round(o.ci_low, 6) AS ci_low, round(o.ci_high, 6) AS ci_high, round(r.rate, 6) AS reference_rate, round(o.rate - r.rate, 6) + 0.0 AS rate_change
FROM rates_ci o JOIN rates_ci r USING (outcome, weighting) WHERE o.late AND NOT r.late""",
        "rates_ci",
    ),
)
def label_drift(spark, sf_dir):
    observed = D.label_rates(label_rows(spark, sf_dir, True), "weight")
    reference = D.label_rates(label_rows(spark, sf_dir, False), "weight")
    return rounded(rounded(D.label_drift(observed, reference), 4, "valid_weight"))


@query(
    "null_label_policy",
    sql("SELECT late, outcome, valid_n, missing_n FROM label_sums", "label_sums"),
)
def null_label_policy(spark, sf_dir):
    parts = [
        label_rows(spark, sf_dir, late)
        .groupBy("outcome")
        .agg(F.count("y").alias("valid_n"), F.count_if(F.col("y").isNull()).alias("missing_n"))
        .withColumn("late", F.lit(late))
        for late in (False, True)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "effective_size_wilson",
    sql(
        """SELECT line_no, round(rate, 6) AS rate, round(greatest(0, (k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS low,
  round(least(1, (k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((k / n * (1 - k / n) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS high
FROM (SELECT line_no, wy / w AS rate, round_even(wy / w * (w * w / ww), 0) AS k, round_even(w * w / ww, 0) AS n, 1.959963984540054::DOUBLE AS z
  FROM (SELECT line_no, sum(weight) AS w, sum(weight * weight) AS ww, sum(weight * y_any) AS wy FROM scored GROUP BY 1))""",
        "scored",
    ),
)
def effective_size_wilson(spark, sf_dir):
    w = F.col("weight")
    sums = scored_lines(spark, sf_dir).groupBy("line_no").agg(
        F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * F.col("y_any")).alias("wy")
    )
    rate = F.col("wy") / F.col("w")
    low, high = wilson_effective(rate, F.col("w"), F.col("ww"))
    return rounded(sums.select("line_no", rate.alias("rate"), low.alias("low"), high.alias("high")))


cte("halves_long", "SELECT *, status = 'F' AS late FROM long", "long")
_DRIFT_GROUPS = "late, model, outcome"
cte("half_metrics", metrics_sql("halves_long", _DRIFT_GROUPS, "weight").replace(", 6)", ", 12)"), "halves_long")
cte(
    "half_scores",
    """SELECT late, model, outcome, ln(p / (1 - p)) AS x, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg FROM
 (SELECT * REPLACE (least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p) FROM halves_long) GROUP BY 1, 2, 3, 4""",
    "halves_long",
)
cte("half_fits", newton_sql("half_scores", _DRIFT_GROUPS).replace(", 5)", ", 12)"), "half_scores")
cte(
    "half_all",
    """SELECT m.*, CASE WHEN status = 'OK' THEN calibration_intercept END AS calibration_intercept, CASE WHEN status = 'OK' THEN calibration_slope END AS calibration_slope
FROM half_metrics m JOIN half_fits USING (late, model, outcome)""",
    "half_metrics",
    "half_fits",
)
_DRIFT = ("calibration_intercept", "calibration_slope", "prevalence", "auroc", "auprc", "brier", "log_loss", "observed_expected")


@query(
    "metric_drift",
    sql(
        " UNION ALL ".join(
            f"""SELECT model, outcome, '{m}' AS metric, round(o.{m}, 4) + 0.0 AS observed_value, round(r.{m}, 4) + 0.0 AS reference_value, round(o.{m} - r.{m}, 4) + 0.0 AS change
  FROM (SELECT * FROM half_all WHERE late) o JOIN (SELECT * FROM half_all WHERE NOT late) r USING (model, outcome)"""
            for m in _DRIFT
        ),
        "half_all",
    ),
)
def metric_drift(spark, sf_dir):
    """Calibration intercept and slope, and the other metrics, of every score and outcome against the earlier rows."""
    groups = ["late", "model", "outcome"]
    rows = M.scores_long(scored_lines(spark, sf_dir).withColumn("late", F.col("status") == "F"), ["late", "weight"], PAIRS)
    table = materialise(M.score_table(rows, groups, "p", "y", "weight"), "scores")
    both = M.summarise_scores(table, groups).join(M.fit_logit(table, groups), groups)
    both = materialise(both, "half-metrics")
    out = D.metric_drift(both.where("late"), both.where("NOT late"), ["model", "outcome"], _DRIFT)
    return rounded(out, 4)


cte(
    "cov_obs",
    "SELECT dimension, level, count(*) AS n_rows, sum((y <> 0)::INT)::BIGINT AS event_count, avg(((mask_all >> y) & 1)::INT) AS coverage, avg(bit_count(mask_all)) AS mean_set_size, avg(abstain::INT) AS abstention_rate FROM "
    "(SELECT *, 'sex' AS dimension, sex AS level FROM decided UNION ALL SELECT *, 'band', band FROM decided) WHERE NOT (dimension = 'band' AND level = 'band1') GROUP BY 1, 2",
    "decided",
)
cte(
    "cov_ref",
    "SELECT dimension, level, avg(((mask_sex >> y) & 1)::INT) AS coverage, avg(bit_count(mask_sex)) AS mean_set_size, avg((bit_count(mask_sex) <> 1)::INT) AS abstention_rate FROM "
    "(SELECT *, 'sex' AS dimension, sex AS level FROM decided UNION ALL SELECT *, 'band', band FROM decided) WHERE NOT (dimension = 'band' AND level = 'band2') GROUP BY 1, 2",
    "decided",
)


@query(
    "coverage_drift",
    sql(
        """SELECT dimension, level, coalesce(n_rows, 0) AS n_rows, coalesce(event_count, 0) AS event_count, round(o.coverage, 6) AS coverage, round(o.mean_set_size, 6) AS mean_set_size,
  round(o.abstention_rate, 6) AS abstention_rate, round(r.coverage, 6) AS coverage_reference, round(r.mean_set_size, 6) AS mean_set_size_reference, round(r.abstention_rate, 6) AS abstention_rate_reference,
  round(o.coverage - r.coverage, 6) + 0.0 AS coverage_change, round(o.mean_set_size - r.mean_set_size, 6) + 0.0 AS mean_set_size_change, round(o.abstention_rate - r.abstention_rate, 6) + 0.0 AS abstention_rate_change,
  CASE WHEN o.n_rows IS NULL THEN 'UNDEFINED_EMPTY_SUBGROUP' WHEN r.coverage IS NULL THEN 'NO_FROZEN_REFERENCE_NEW_STRATUM' ELSE 'OK' END AS status
FROM cov_obs o FULL JOIN cov_ref r USING (dimension, level)""",
        "cov_obs",
        "cov_ref",
    ),
)
def coverage_drift(spark, sf_dir):
    """One level is missing from the new rows, one has no reference."""
    rows = class_sets(spark, sf_dir)
    dimensions = {d: F.col(c) for d, c in DIMENSIONS.items()}
    keep = ["dimension", "level", "n_rows", "event_count", "coverage", "mean_set_size", "abstention_rate"]
    observed = P.coverage_by_subgroup(rows, [], dimensions, "mask_all", "y", "abstain").where("level <> 'band1'").select(*keep)
    reference = P.coverage_by_subgroup(rows, [], dimensions, "mask_sex", "y").where("level <> 'band2'").select(*keep)
    declared = spark.createDataFrame([("band", f"band{k}") for k in range(3)], "dimension string, level string")
    out = D.coverage_drift(observed, reference.drop("n_rows", "event_count"), ["dimension", "level"], declared)
    return rounded(out)


@query(
    "label_drift_bounds",
    sql(
        """SELECT round(quantile_cont(u, 0.025), 5) AS unweighted_rate_low, round(quantile_cont(u, 0.975), 5) AS unweighted_rate_high, count(u) AS unweighted_rate_defined,
  round(quantile_cont(v, 0.025), 5) AS weighted_rate_low, round(quantile_cont(v, 0.975), 5) AS weighted_rate_high, count(v) AS weighted_rate_defined
FROM (SELECT replicate, sum(mult * y_part) / sum(mult)::DOUBLE AS u, sum(mult * weight * y_part) / sum(mult * weight) AS v FROM scored JOIN draws_e USING (entity_id) GROUP BY 1)""",
        "draws_e",
    ),
)
def label_drift_bounds(spark, sf_dir):
    reps = S.replicate_rates(scored_lines(spark, sf_dir), entity_draws(spark, sf_dir), [], "y_part", "weight")
    return rounded(S.intervals(reps, [], ["unweighted_rate", "weighted_rate"]), 5)


# disclosure -------------------------------------------------------------------------------

cte(
    "monthly_rates",
    """SELECT partition_label, lpad(month::VARCHAR, 2, '0') AS month, count(*) AS n_rows, sum(any_follow_up::INT)::BIGINT AS event_count, avg(any_follow_up::INT) AS event_rate,
  'OK' AS status, 60 AS n_replicates FROM parts WHERE eligible GROUP BY 1, 2""",
    "parts",
)


def monthly_rates(spark, sf_dir):
    rows = episodes(spark, sf_dir).where("eligible").withColumn("partition_label", partition_label())
    return rows.groupBy("partition_label", F.lpad(F.col("month").cast("string"), 2, "0").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("any_follow_up").alias("event_count"),
        F.avg(F.col("any_follow_up").cast("double")).alias("event_rate"),
    ).withColumns({"status": F.lit("OK"), "n_replicates": F.lit(60)})


@query(
    "small_cell_suppression",
    sql(
        """SELECT partition_label, month, CASE WHEN ok THEN n_rows END AS n_rows, CASE WHEN ok THEN event_count END AS event_count,
  CASE WHEN ok THEN round(event_rate, 6) END AS event_rate, CASE WHEN ok THEN status ELSE 'SUPPRESSED_SMALL_CELL' END AS status, n_replicates
FROM (SELECT *, n_rows > 10 AND event_count > 10 AS ok FROM monthly_rates)""",
        "monthly_rates",
    ),
)
def small_cell_suppression(spark, sf_dir):
    return rounded(X.suppress(X.check_public_columns(monthly_rates(spark, sf_dir))))


@query(
    "suppression_audit",
    sql(
        """SELECT 'partition_label=' || partition_label || '|month=' || month AS row_key,
  concat_ws(';', CASE WHEN n_rows <= 10 THEN 'n_rows' END, CASE WHEN event_count <= 10 THEN 'event_count' END) AS trigger_fields, true AS suppressed
FROM monthly_rates WHERE n_rows <= 10 OR event_count <= 10""",
        "monthly_rates",
    ),
)
def suppression_audit(spark, sf_dir):
    return X.suppression_audit(monthly_rates(spark, sf_dir), ["partition_label", "month"])


@query(
    "public_counts",
    sql(
        """SELECT partition_label, month, CASE WHEN event_count > 10 THEN event_count END AS events_shown, event_count <= 10 AS events_held_back,
  CASE WHEN n_rows <= 10 THEN 'SUPPRESSED_N_LE_10' ELSE n_rows::VARCHAR END AS n_text FROM monthly_rates""",
        "monthly_rates",
    ),
)
def public_counts(spark, sf_dir):
    shown, held = X.public_count(F.col("event_count"))
    return monthly_rates(spark, sf_dir).select(
        "partition_label",
        "month",
        shown.alias("events_shown"),
        held.alias("events_held_back"),
        X.public_count_text(F.col("n_rows")).alias("n_text"),
    )


@query(
    "public_table_scan",
    sql("SELECT 'event_count' AS \"column\", event_count::DOUBLE AS value FROM monthly_rates WHERE event_count BETWEEN 1 AND 10", "monthly_rates"),
)
def public_table_scan(spark, sf_dir):
    rates = monthly_rates(spark, sf_dir)
    if X.leaked_identifiers(rates) or not X.unsuppressed_counts(X.suppress(rates)).isEmpty():
        raise ValueError("the suppressed table still shows small counts")
    return X.unsuppressed_counts(rates)


