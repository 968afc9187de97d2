"""Evaluation of scores, and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.values import wilson
from strandline.operators import metrics as M
from strandline.operators import ordering as O
from strandline.operators import resample as S
from strandline.operators.draws import draw_table, draws_sql, plan_draws
from strandline.plans.bindings import scored_documents, scored_lines, table, unique_lines
from strandline.plans.registry import cte, query, rnd, rounded, sql
from strandline.plans.stages import planned, staged
from strandline.session import materialise

PAIRS = {
    ("fine", "any"): ("y_any", "p_fine"),
    ("tied", "any"): ("y_any", "p_tied"),
    ("fine", "part"): ("y_part", "p_fine"),
    ("tied", "part"): ("y_part", "p_tied"),
}
THRESHOLDS = {"fine": 0.4, "tied": 0.45}
GRID = ["model", "outcome", "weighting"]

_LONG = " UNION ALL ".join(
    f"SELECT *, '{m}' AS model, '{o}' AS outcome, {y} AS y, {p} AS p FROM scored" for (m, o), (y, p) in PAIRS.items()
)
cte("long", f"SELECT * FROM ({_LONG})", "scored")
cte(
    "grid",
    "SELECT *, 'unweighted' AS weighting, 1.0::DOUBLE AS w FROM long UNION ALL SELECT *, 'weighted', weight FROM long",
    "long",
)


def metrics_sql(source: str, groups: str, weight: str, eps: str = "1e-15") -> str:
    """All threshold-free metrics of a source with columns y, p and a weight."""
    part = f"PARTITION BY {groups}" if groups else ""
    lead = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {lead}sum(n)::BIGINT AS n_rows, sum(ev)::BIGINT AS event_count, round(sum(pos + neg), 4) AS weight_sum,
  round(sum(pos), 4) AS weighted_event_count, round(sum(pos) / sum(pos + neg), 6) AS prevalence,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) END AS auroc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * cpos / call) FILTER (WHERE pos > 0) / sum(pos), 6) END AS auprc,
  round(sum(pos * (1 - p) ** 2 + neg * p ** 2) / sum(pos + neg), 6) AS brier,
  round(sum(-(pos * ln(greatest(least(p, 1 - {eps}::DOUBLE), {eps}::DOUBLE)) + neg * ln(1 - greatest(least(p, 1 - {eps}::DOUBLE), {eps}::DOUBLE)))) / sum(pos + neg), 6) AS log_loss,
  round(sum(pos) / sum(p * (pos + neg)), 6) AS observed_expected,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN 'OK' ELSE 'UNDEFINED_SINGLE_OUTCOME_CLASS' END AS status
FROM (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(pos) OVER ({part} ORDER BY p DESC) AS cpos, sum(pos + neg) OVER ({part} ORDER BY p DESC) AS call
  FROM (SELECT {lead}p, count(*) AS n, sum(y) AS ev, sum(({weight}) * y) AS pos, sum(({weight}) * (1 - y)) AS neg FROM {source} GROUP BY {lead}p)) {by}"""


_DIGITS4 = ("weight_sum", "weighted_event_count")


def tidy(df):
    """Sums to four digits, rates to six."""
    return rounded(rounded(df, 4, *[c for c in _DIGITS4 if c in df.columns]))


def grid_rows(spark, sf_dir):
    rows = M.scores_long(scored_lines(spark, sf_dir), ["weight"], PAIRS)
    return M.weightings_long(rows, ["model", "outcome", "y", "p"], "weight")


@query("metric_grid", sql(metrics_sql("grid", "model, outcome, weighting", "w"), "grid"))
def metric_grid(spark, sf_dir):
    return tidy(M.binary_metrics(grid_rows(spark, sf_dir), GRID, "p", "y", "w"))


@query(
    "subgroup_metrics",
    sql(
        "SELECT * FROM ("
        + metrics_sql(
            "(SELECT *, 'status' AS dimension, status AS level FROM scored s, LATERAL (SELECT y_any AS y, p_fine AS p) UNION ALL "
            "SELECT *, 'line', line_no::VARCHAR FROM scored s, LATERAL (SELECT y_any AS y, p_fine AS p))",
            "dimension, level",
            "weight",
        )
        + ") WHERE n_rows >= 100 AND event_count >= 20",
        "scored",
    ),
)
def subgroup_metrics(spark, sf_dir):
    rows = M.subgroups_long(
        scored_lines(spark, sf_dir), ["y_any", "p_fine", "weight"], {"status": F.col("status"), "line": F.col("line_no")}
    )
    out = M.binary_metrics(rows, ["dimension", "level"], "p_fine", "y_any", "weight")
    return tidy(out.where((F.col("n_rows") >= 100) & (F.col("event_count") >= 20)))


@query(
    "first_row_sensitivity",
    sql(
        metrics_sql("(SELECT weight, y_any AS y, p_fine AS p FROM uniq WHERE row_id IN (SELECT min(row_id) FROM uniq GROUP BY entity_id))", "", "weight"),
        "uniq",
    ),
)
def first_row_sensitivity(spark, sf_dir):
    """Metrics on the first row of every entity."""
    rows = unique_lines(spark, sf_dir)
    first = rows.groupBy("entity_id").agg(F.min(F.struct("row_id", "y_any", "p_fine", "weight")).alias("r")).select("r.*")
    return tidy(M.binary_metrics(first, [], "p_fine", "y_any", "weight"))


@query(
    "auroc_row_order",
    sql(
        """SELECT line_no, round(sum(pos * (cneg - neg / 2)) / (sum(pos) * sum(neg)), 6) AS auroc FROM
 (SELECT *, sum(neg) OVER (PARTITION BY line_no ORDER BY p_tied, row_id ROWS UNBOUNDED PRECEDING) AS cneg FROM
   (SELECT line_no, row_id, p_tied, weight * y_any AS pos, weight * (1 - y_any) AS neg FROM uniq)) GROUP BY 1""",
        "uniq",
    ),
)
def auroc_row_order(spark, sf_dir):
    return rounded(M.auroc_row_order(unique_lines(spark, sf_dir), ["line_no"], "p_tied", "y_any", "weight", "row_id"))


def _ap_sql(order):
    return sql(
        f"""SELECT line_no, round(sum(c / r::DOUBLE) FILTER (WHERE y_any = 1) / sum(y_any), 6) AS average_precision FROM
 (SELECT line_no, y_any, sum(y_any) OVER w AS c, row_number() OVER w AS r FROM uniq
  WINDOW w AS (PARTITION BY line_no ORDER BY {order} ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
        "uniq",
    )


@query("average_precision_row_order", _ap_sql("p_tied DESC, row_id"))
def average_precision_row_order(spark, sf_dir):
    return rounded(M.average_precision_rows(unique_lines(spark, sf_dir), ["line_no"], "p_tied", "y_any", "row_id"))


@query("average_precision_positives_first", _ap_sql("p_tied DESC, y_any DESC, row_id"))
def average_precision_positives_first(spark, sf_dir):
    rows = unique_lines(spark, sf_dir)
    return rounded(M.average_precision_rows(rows, ["line_no"], "p_tied", "y_any", "row_id", positives_first=True))


# calibration ------------------------------------------------------------------------

def newton_sql(table: str, groups: str, steps: int = 12) -> str:
    """Newton steps written out one after the other; ``table`` has groups, x, pos, neg."""
    parts = [f"n0 AS (SELECT DISTINCT {groups}, 0.0::DOUBLE AS b0, 1.0::DOUBLE AS b1 FROM {table})"]
    for i in range(steps):
        parts.append(
            f"""n{i + 1} AS (SELECT {groups}, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0,
  b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM
 (SELECT {groups}, b0, b1, sum(pos - (pos + neg) * mu) AS g0, sum((pos - (pos + neg) * mu) * x) AS g1,
    sum((pos + neg) * mu * (1 - mu)) AS h00, sum((pos + neg) * mu * (1 - mu) * x) AS h01, sum((pos + neg) * mu * (1 - mu) * x * x) AS h11
  FROM (SELECT t.*, b0, b1, 1 / (1 + exp(-(b0 + b1 * x))) AS mu FROM {table} t JOIN n{i} USING ({groups})) GROUP BY {groups}, b0, b1))"""
        )
    return "WITH " + ",\n".join(parts) + f"\nSELECT {groups}, round(b0, 5) + 0.0 AS calibration_intercept, round(b1, 5) + 0.0 AS calibration_slope, 'OK' AS calibration_status FROM n{steps}"


cte(
    "logits",
    """SELECT model, outcome, weighting, ln(p / (1 - p)) AS x, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM
 (SELECT * REPLACE (least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p) FROM grid) GROUP BY 1, 2, 3, 4""",
    "grid",
)


@query("calibration_intercept_slope", sql(newton_sql("logits", "model, outcome, weighting"), "logits"))
def calibration_intercept_slope(spark, sf_dir):
    table = M.score_table(grid_rows(spark, sf_dir), GRID, "p", "y", "w")
    return rounded(M.fit_logit(table, GRID), 5)


cte(
    "mid",
    """SELECT line_no, p_fine AS x, (sum(weight) OVER (PARTITION BY line_no ORDER BY p_fine, row_id ROWS UNBOUNDED PRECEDING) - weight / 2)
  / sum(weight) OVER (PARTITION BY line_no) AS c FROM uniq""",
    "uniq",
)
cte(
    "cuts",
    """SELECT line_no, list_sort(list_distinct(list(v)))[2:-2] AS cuts FROM (
 SELECT line_no, q, CASE WHEN lo.x IS NULL THEN hi.x WHEN hi.x IS NULL THEN lo.x WHEN hi.c > lo.c THEN lo.x + (hi.x - lo.x) * (q - lo.c) / (hi.c - lo.c) ELSE lo.x END AS v
 FROM (SELECT DISTINCT line_no, q FROM mid, (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS q))
 LEFT JOIN (SELECT line_no, q, max(c) AS c, arg_max(x, {'c': c, 'x': x}) AS x FROM mid, (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS q) WHERE c <= q GROUP BY 1, 2) lo USING (line_no, q)
 LEFT JOIN (SELECT line_no, q, min(c) AS c, arg_min(x, {'c': c, 'x': x}) AS x FROM mid, (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS q) WHERE c >= q GROUP BY 1, 2) hi USING (line_no, q)) GROUP BY 1""",
    "mid",
)
cte(
    "binned",
    "SELECT u.*, (len(list_filter(cuts, lambda c: c < p_fine)) + 1)::INT AS bin FROM uniq u JOIN cuts USING (line_no)",
    "cuts",
)
cte(
    "bins",
    """SELECT line_no, bin, count(*) AS n, sum(weight) AS w, sum(weight * p_fine) / sum(weight) AS predicted, sum(weight * y_any) / sum(weight) AS observed
FROM binned GROUP BY 1, 2""",
    "binned",
)


@staged
def binned_lines(spark, sf_dir):
    return M.with_weighted_bin(unique_lines(spark, sf_dir), ["line_no"], "p_fine", "weight", "row_id")


def bin_rows(spark, sf_dir):
    return M.bin_summary(binned_lines(spark, sf_dir), ["line_no"], "p_fine", "y_any", "weight")


@query(
    "calibration_bins",
    sql("SELECT line_no, bin, n, round(w, 4) AS weight_sum, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM bins", "bins"),
)
def calibration_bins(spark, sf_dir):
    return tidy(bin_rows(spark, sf_dir))


@query(
    "integrated_calibration_error",
    sql("SELECT line_no, round(sum(w * abs(observed - predicted)) / sum(w), 6) AS ici FROM bins GROUP BY 1", "bins"),
)
def integrated_calibration_error(spark, sf_dir):
    return rounded(M.integrated_calibration_error(bin_rows(spark, sf_dir), ["line_no"]))


cte(
    "deciles",
    """SELECT *, greatest(ceil(i * 10 / greatest(n - 1, 1)::DOUBLE), 1)::INT AS bin FROM
 (SELECT *, row_number() OVER (ORDER BY p_tied, row_id) - 1 AS i, count(*) OVER () AS n FROM uniq)""",
    "uniq",
)


@query(
    "equal_count_deciles",
    sql("SELECT bin, count(*) AS n, round(avg(p_tied), 6) AS predicted, round(avg(y_any), 6) AS observed FROM deciles GROUP BY 1", "deciles"),
)
def equal_count_deciles(spark, sf_dir):
    rows = M.with_equal_count_bin(unique_lines(spark, sf_dir), [], "p_tied", "row_id")
    return rounded(
        rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p_tied").alias("predicted"), F.avg("y_any").alias("observed"))
    )


# operating points ----------------------------------------------------------------------

_T = "CASE model WHEN 'fine' THEN 0.4::DOUBLE ELSE 0.45::DOUBLE END"
_RATES = """round((tp + fp) / (tp + fp + tn + fn), 6) AS flagged_fraction, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity,
  round(tp / (tp + fp), 6) AS ppv, round(tn / (tn + fn), 6) AS npv, round(1000 * (tp + fp) / (tp + fp + tn + fn), 6) AS flagged_per_1000,
  round((tp - fp * threshold / (1 - threshold)) / (tp + fp + tn + fn), 6) + 0.0 AS net_benefit"""
_CONFUSION = """coalesce(sum({w}) FILTER (WHERE p >= threshold AND y = 1), 0) AS tp, coalesce(sum({w}) FILTER (WHERE p >= threshold AND y = 0), 0) AS fp,
  coalesce(sum({w}) FILTER (WHERE p < threshold AND y = 0), 0) AS tn, coalesce(sum({w}) FILTER (WHERE p < threshold AND y = 1), 0) AS fn"""


def with_threshold(df):
    return df.withColumn("threshold", F.when(F.col("model") == "fine", F.lit(THRESHOLDS["fine"])).otherwise(F.lit(THRESHOLDS["tied"])))


@query(
    "threshold_report",
    sql(
        f"""SELECT model, outcome, weighting, threshold, round(tp, 4) AS tp, round(fp, 4) AS fp, round(tn, 4) AS tn, round(fn, 4) AS fn, {_RATES}
FROM (SELECT model, outcome, weighting, threshold, {_CONFUSION.format(w='w')} FROM (SELECT *, {_T} AS threshold FROM grid) GROUP BY 1, 2, 3, 4)""",
        "grid",
    ),
)
def threshold_report(spark, sf_dir):
    out = M.threshold_report(with_threshold(grid_rows(spark, sf_dir)), GRID, "p", "y", "w", "threshold")
    return rounded(rounded(out, 4, "tp", "fp", "tn", "fn"))


_CURVE = """SELECT {groups}, threshold, round((tp - fp * threshold / (1 - threshold)) / n, 8) + 0.0 AS net_benefit,
  round(pos / n - (1 - pos / n) * threshold / (1 - threshold), 8) + 0.0 AS treat_all_net_benefit, 0.0::DOUBLE AS treat_none_net_benefit
FROM (SELECT {groups}, threshold, sum(w) AS n, sum(w * y) AS pos, sum(w * y * (p >= threshold)::INT) AS tp, sum(w * (1 - y) * (p >= threshold)::INT) AS fp
      FROM {source}, (SELECT {points} AS threshold) GROUP BY ALL)"""


@query(
    "decision_curve",
    sql(
        _CURVE.format(groups="model, outcome, weighting", source="grid", points="unnest(range(1, 51)) / 100.0::DOUBLE"),
        "grid",
    ),
)
def decision_curve(spark, sf_dir):
    thresholds = [i / 100 for i in range(1, 51)]
    return rounded(M.decision_curve(grid_rows(spark, sf_dir), GRID, "p", "y", "w", thresholds), 8)


@query(
    "selection_score",
    sql(
        f"""SELECT model, round(avg(auprc), 5) AS mean_auprc, round(avg(brier), 5) AS mean_brier FROM ({metrics_sql('long', 'model, outcome', '1.0::DOUBLE')}) GROUP BY 1""",
        "long",
    ),
)
def selection_score(spark, sf_dir):
    rows = M.scores_long(scored_lines(spark, sf_dir), [], PAIRS)
    return rounded(M.selection_score(M.binary_metrics(rows, ["model", "outcome"], "p", "y")), 5)


CAPACITY = 0.2
cte("audited", " UNION ALL ".join(f"SELECT row_id, weight, '{m}' AS model, '{o}' AS outcome, {y} AS y, {p} AS p FROM uniq" for (m, o), (y, p) in PAIRS.items()), "uniq")


@query(
    "score_audit",
    sql(
        f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY model, outcome ORDER BY p DESC, row_id) AS r, count(*) OVER (PARTITION BY model, outcome) AS n FROM audited),
facts AS (SELECT model, outcome, count(*) AS n_rows, (count(*) - count(DISTINCT row_id))::BIGINT AS repeated_keys, bool_and(isfinite(p)) AS finite,
  bool_and(p BETWEEN 0 AND 1) AS in_range, stddev_pop(p) AS sd, count(*) FILTER (WHERE r <= ceil(n * {CAPACITY}::DOUBLE)) AS flagged_rows FROM ranked GROUP BY 1, 2)
SELECT model, outcome, f.n_rows, repeated_keys, finite, in_range, round(sd, 6) AS sd, flagged_rows, m.auroc, m.auprc, m.prevalence,
  concat_ws(';', CASE WHEN f.n_rows <> (SELECT count(*) FROM lineitem) THEN 'row_count' END, CASE WHEN (SELECT count(*) FROM facts) <> {len(PAIRS)} THEN 'score_columns' END,
    CASE WHEN repeated_keys > 0 THEN 'repeated_keys' END, CASE WHEN NOT finite THEN 'not_finite' END, CASE WHEN NOT in_range THEN 'out_of_range' END,
    CASE WHEN NOT sd > 1e-8 THEN 'constant' END, CASE WHEN flagged_rows <> ceil(f.n_rows * {CAPACITY}::DOUBLE) THEN 'capacity' END,
    CASE WHEN NOT (m.auroc > 0.5 AND m.auprc > m.prevalence) THEN 'direction' END) AS failures
FROM facts f JOIN ({metrics_sql('audited', 'model, outcome', '1.0::DOUBLE')}) m USING (model, outcome)""",
        "audited",
    ),
)
def score_audit(spark, sf_dir):
    """Expected rows and score columns, distinct keys, sound scores, exact capacity and direction of every score."""
    rows = unique_lines(spark, sf_dir)
    flagged = rows
    for model in dict.fromkeys(m for m, _ in PAIRS):
        flagged, _ = O.capacity_flags(flagged, f"p_{model}", "row_id", CAPACITY, f"flag_{model}")
    long = M.scores_long(flagged, ["row_id", *[f"flag_{m}" for m in THRESHOLDS]], PAIRS)
    flag = F.when(F.col("model") == "fine", F.col("flag_fine")).otherwise(F.col("flag_tied"))
    expected = table(spark, sf_dir, "lineitem").count()
    long = materialise(long.withColumn("flagged", flag), "audited")
    return rounded(M.score_audit(long, ["model", "outcome"], "row_id", "p", "y", "flagged", expected, len(PAIRS), CAPACITY))


# resampling --------------------------------------------------------------------------------

SEED, REPS = 7, 1000
ENTITY_SEED, ENTITY_REPS = 11, 1000

cte("draws_f", draws_sql("scored", "stratum", "facility_id", REPS, SEED), "scored")
cte("draws_e", draws_sql("scored", "", "entity_id", ENTITY_REPS, ENTITY_SEED), "scored")


@planned
def facility_draws(spark, sf_dir):
    return plan_draws(scored_lines(spark, sf_dir), ["stratum"], "facility_id", REPS, SEED)


@planned
def entity_draws(spark, sf_dir):
    return plan_draws(scored_lines(spark, sf_dir), [], "entity_id", ENTITY_REPS, ENTITY_SEED)


@query("stratified_cluster_draws", sql("SELECT * FROM draws_f", "draws_f"))
def stratified_cluster_draws(spark, sf_dir):
    return draw_table(facility_draws(spark, sf_dir))


@query(
    "cluster_draws",
    sql(
        """SELECT entity_id, count(*) AS n_replicates, sum(mult)::BIGINT AS n_draws, max(mult) AS largest, sum(replicate * mult)::BIGINT AS replicate_sum,
  sum(replicate * replicate * mult * mult)::BIGINT AS square_sum FROM draws_e GROUP BY 1""",
        "draws_e",
    ),
)
def cluster_draws(spark, sf_dir):
    """Of each entity: the replicates that draw it, how often, and sums that fix which ones they are."""
    rep, mult = F.col("replicate").cast("long"), F.col("mult").cast("long")
    return draw_table(entity_draws(spark, sf_dir)).groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_replicates"),
        F.sum(mult).alias("n_draws"),
        F.max("mult").alias("largest"),
        F.sum(rep * mult).alias("replicate_sum"),
        F.sum(rep * rep * mult * mult).alias("square_sum"),
    )


cte(
    "rep_rows",
    "SELECT l.model, l.outcome, l.y, l.p, d.replicate, weight * d.mult AS w FROM long l JOIN draws_f d USING (stratum, facility_id)",
    "long",
    "draws_f",
)
ON = ["stratum", "facility_id"]


def long_rows(spark, sf_dir, *keep):
    return M.scores_long(scored_lines(spark, sf_dir), ["weight", *keep], PAIRS)


@staged
def facility_replicates(spark, sf_dir):
    """Metrics of every replicate, score and outcome."""
    rows = long_rows(spark, sf_dir, *ON)
    return S.replicate_metrics(rows, facility_draws(spark, sf_dir), ["model", "outcome"], "p", "y", "weight")


_REP = metrics_sql("rep_rows", "replicate, model, outcome", "w")
_FAMILY = ("auroc", "auprc", "brier", "log_loss", "prevalence", "observed_expected")


@query(
    "replicate_metrics",
    sql(f"SELECT replicate, model, outcome, {', '.join(_FAMILY)} FROM ({_REP})", "rep_rows"),
)
def replicate_metrics(spark, sf_dir):
    return rounded(facility_replicates(spark, sf_dir).select("replicate", "model", "outcome", *_FAMILY))


@query(
    "percentile_intervals",
    sql(
        "SELECT model, outcome, "
        + ", ".join(
            f"round(quantile_cont({m}, 0.025), 5) AS {m}_low, round(quantile_cont({m}, 0.975), 5) AS {m}_high, count({m}) AS {m}_defined" for m in _FAMILY
        )
        + f" FROM ({_REP.replace(', 6)', ', 12)')}) GROUP BY 1, 2",
        "rep_rows",
    ),
)
def percentile_intervals(spark, sf_dir):
    return rounded(S.intervals(facility_replicates(spark, sf_dir), ["model", "outcome"], _FAMILY), 5)


@query(
    "replicate_operating_points",
    sql(
        f"""SELECT replicate, model, outcome, threshold, round(tp, 4) AS tp, round(fp, 4) AS fp, round(tn, 4) AS tn, round(fn, 4) AS fn, {_RATES} FROM
 (SELECT replicate, model, outcome, threshold, {_CONFUSION.format(w='weight * mult')} FROM (SELECT l.*, d.replicate, d.mult, {_T} AS threshold
   FROM long l JOIN draws_f d USING (stratum, facility_id)) GROUP BY 1, 2, 3, 4)""",
        "long",
        "draws_f",
    ),
)
def replicate_operating_points(spark, sf_dir):
    rows = with_threshold(long_rows(spark, sf_dir, *ON))
    out = S.replicate_operating(rows, facility_draws(spark, sf_dir), ["model", "outcome"], "p", "y", "weight", "threshold")
    return rounded(rounded(out, 4, "tp", "fp", "tn", "fn"))


@query(
    "replicate_rates",
    sql(
        """SELECT replicate, sum(mult)::BIGINT AS n, round(sum(mult * weight), 4) AS w, round(sum(mult * y_any) / sum(mult)::DOUBLE, 6) AS unweighted_rate,
  round(sum(mult * weight * y_any) / sum(mult * weight), 6) AS weighted_rate FROM scored JOIN draws_e USING (entity_id) GROUP BY 1""",
        "scored",
        "draws_e",
    ),
)
def replicate_rates(spark, sf_dir):
    out = S.replicate_rates(scored_lines(spark, sf_dir), entity_draws(spark, sf_dir), [], "y_any", "weight")
    return rounded(rounded(out, 4, "w"))


@query(
    "entity_bootstrap_metrics",
    sql(
        "SELECT replicate, auroc, auprc, brier FROM ("
        + metrics_sql("(SELECT y_any AS y, p_tied AS p, replicate, mult FROM scored JOIN draws_e USING (entity_id))", "replicate", "mult")
        + ")",
        "scored",
        "draws_e",
    ),
)
def entity_bootstrap_metrics(spark, sf_dir):
    out = S.replicate_metrics(scored_lines(spark, sf_dir), entity_draws(spark, sf_dir), [], "p_tied", "y_any")
    return rounded(out.select("replicate", "auroc", "auprc", "brier"))


cte(
    "rep_logits",
    """SELECT replicate, model, outcome, ln(p / (1 - p)) AS x, sum(weight * mult * y) AS pos, sum(weight * mult * (1 - y)) AS neg FROM
  (SELECT l.* REPLACE (least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p), d.replicate, d.mult FROM long l JOIN draws_f d USING (stratum, facility_id)) GROUP BY 1, 2, 3, 4""",
    "long",
    "draws_f",
)


@query("bootstrap_calibration", sql(newton_sql("rep_logits", "replicate, model, outcome", 8), "rep_logits"))
def bootstrap_calibration(spark, sf_dir):
    groups = ["model", "outcome"]
    table = S.replicate_scores(long_rows(spark, sf_dir, *ON), facility_draws(spark, sf_dir), groups, "p", "y", "weight")
    return rounded(M.fit_logit(table, ["replicate", *groups]), 5)


@query(
    "calibration_curve_intervals",
    sql(
        """SELECT bin, any_value(n) AS n, round(any_value(predicted), 6) AS predicted, round(any_value(observed), 6) AS observed,
  round(quantile_cont(o, 0.025), 5) AS observed_low, round(quantile_cont(o, 0.975), 5) AS observed_high,
  round(quantile_cont(p, 0.025), 5) AS predicted_low, round(quantile_cont(p, 0.975), 5) AS predicted_high
FROM (SELECT bin, replicate, sum(mult * weight * y_any) / sum(mult * weight) AS o, sum(mult * weight * p_tied) / sum(mult * weight) AS p
      FROM deciles JOIN draws_f USING (stratum, facility_id) GROUP BY 1, 2)
JOIN (SELECT bin, count(*) AS n, sum(weight * p_tied) / sum(weight) AS predicted, sum(weight * y_any) / sum(weight) AS observed FROM deciles GROUP BY 1) USING (bin) GROUP BY 1""",
        "deciles",
        "draws_f",
    ),
)
def calibration_curve_intervals(spark, sf_dir):
    rows = M.with_equal_count_bin(unique_lines(spark, sf_dir), [], "p_tied", "row_id")
    w, y, p = F.col("weight"), F.col("y_any"), F.col("p_tied")
    sums = S.replicate_sums(
        rows, facility_draws(spark, sf_dir), ["bin"], {"w": F.sum(w), "wy": F.sum(w * y), "wp": F.sum(w * p)}
    )
    reps = sums.select("bin", (F.col("wy") / F.col("w")).alias("observed"), (F.col("wp") / F.col("w")).alias("predicted"))
    bounds = S.intervals(reps, ["bin"], ["observed", "predicted"]).drop("observed_defined", "predicted_defined")
    point = M.bin_summary(rows, [], "p_tied", "y_any", "weight").drop("weight_sum")
    return rounded(rounded(point.join(bounds, "bin"), 5, "observed_low", "observed_high", "predicted_low", "predicted_high"))


@query(
    "weighted_bin_intervals",
    sql(
        """SELECT line_no, bin, round(quantile_cont(o, 0.025), 5) AS observed_low, round(quantile_cont(o, 0.975), 5) AS observed_high,
  round(quantile_cont(p, 0.025), 5) AS predicted_low, round(quantile_cont(p, 0.975), 5) AS predicted_high
FROM (SELECT line_no, bin, replicate, sum(mult * weight * y_any) / sum(mult * weight) AS o, sum(mult * weight * p_fine) / sum(mult * weight) AS p
      FROM binned JOIN draws_f USING (stratum, facility_id) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "binned",
        "draws_f",
    ),
)
def weighted_bin_intervals(spark, sf_dir):
    """Resampled bounds of observed and predicted rate in weighted-quantile bins."""
    w, y, p = F.col("weight"), F.col("y_any"), F.col("p_fine")
    sums = S.replicate_sums(
        binned_lines(spark, sf_dir), facility_draws(spark, sf_dir), ["line_no", "bin"],
        {"w": F.sum(w), "wy": F.sum(w * y), "wp": F.sum(w * p)},
    )
    reps = sums.select("line_no", "bin", (F.col("wy") / F.col("w")).alias("observed"), (F.col("wp") / F.col("w")).alias("predicted"))
    bounds = S.intervals(reps, ["line_no", "bin"], ["observed", "predicted"])
    return rounded(bounds.drop("observed_defined", "predicted_defined"), 5)


BIN_SEED, BIN_REPS = 23, 1000
cte(
    "doc_bins",
    """SELECT doc_id, y, greatest(ceil(i * 10 / greatest(n - 1, 1)::DOUBLE), 1)::INT AS bin FROM
 (SELECT *, row_number() OVER (ORDER BY p, doc_id) - 1 AS i, count(*) OVER () AS n FROM docs)""",
    "docs",
)
cte("draws_b", draws_sql("doc_bins", "bin", "doc_id", BIN_REPS, BIN_SEED), "doc_bins")


@query(
    "in_bin_resampling",
    sql(
        """SELECT bin, any_value(n) AS n, any_value(events) AS events, round(quantile_cont(o, 0.025), 6) AS observed_low, round(quantile_cont(o, 0.975), 6) AS observed_high
FROM (SELECT bin, replicate, sum(mult * y) / sum(mult)::DOUBLE AS o FROM doc_bins JOIN draws_b USING (bin, doc_id) GROUP BY 1, 2)
JOIN (SELECT bin, count(*) AS n, sum(y)::BIGINT AS events FROM doc_bins GROUP BY 1) USING (bin) GROUP BY 1""",
        "doc_bins",
        "draws_b",
    ),
)
def in_bin_resampling(spark, sf_dir):
    """Rows drawn with replacement inside each equal-count bin."""
    rows = M.with_equal_count_bin(scored_documents(spark, sf_dir).select("doc_id", "y", "p"), [], "p", "doc_id")
    rows = materialise(rows.select("bin", "doc_id", "y"), "bins")
    draws = plan_draws(rows, ["bin"], "doc_id", BIN_REPS, BIN_SEED)
    sums = S.replicate_sums(rows, draws, ["bin"], {"n": F.count(F.lit(1)), "k": F.coalesce(F.sum("y"), F.lit(0))})
    reps = sums.select("bin", (F.col("k") / F.col("n")).alias("observed"))
    point = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))
    return rounded(point.join(S.intervals(reps, ["bin"], ["observed"]).drop("observed_defined"), "bin"))


# paired comparison: two scores, two outcomes ------------------------------------------------

cte(
    "rep_ap",
    "SELECT replicate, outcome, model, auprc FROM (" + _REP.replace(", 6)", ", 14)") + ")",
    "rep_rows",
)
cte(
    "rep_diff",
    """SELECT a.replicate, a.outcome, a.auprc - b.auprc AS difference FROM rep_ap a JOIN rep_ap b USING (replicate, outcome) WHERE a.model = 'fine' AND b.model = 'tied'""",
    "rep_ap",
)
cte("pts", metrics_sql("long", "model, outcome", "weight").replace(", 6)", ", 14)"), "long")
cte(
    "point_diff",
    "SELECT a.outcome, a.auprc - b.auprc AS estimate FROM pts a JOIN pts b USING (outcome) WHERE a.model = 'fine' AND b.model = 'tied'",
    "pts",
)


def differences(spark, sf_dir):
    """AUPRC difference of the two scores per replicate and outcome."""
    return S.paired_difference(facility_replicates(spark, sf_dir), ["outcome"], "model", "fine", "tied", "auprc")


@staged
def point_differences(spark, sf_dir):
    point = M.binary_metrics(long_rows(spark, sf_dir), ["model", "outcome"], "p", "y", "weight")
    ap = point.select("model", "outcome", "auprc")
    fine = ap.where("model = 'fine'").select("outcome", F.col("auprc").alias("_a"))
    tied = ap.where("model = 'tied'").select("outcome", F.col("auprc").alias("_b"))
    return fine.join(tied, "outcome").select("outcome", (F.col("_a") - F.col("_b")).alias("estimate"))


@query(
    "paired_difference",
    sql(
        f"""SELECT outcome, round(any_value(estimate), 6) + 0.0 AS estimate, round(avg(difference), 6) + 0.0 AS mean_difference, round(quantile_cont(difference, 0.025), 5) + 0.0 AS low,
  round(quantile_cont(difference, 0.975), 5) + 0.0 AS high, count(difference) AS n_defined, {REPS}::BIGINT AS n_replicates FROM rep_diff JOIN point_diff USING (outcome) GROUP BY 1""",
        "rep_diff",
        "point_diff",
    ),
)
def paired_difference(spark, sf_dir):
    lo, hi = S.percentile_bounds("difference")
    by = differences(spark, sf_dir).groupBy("outcome").agg(
        rnd(F.avg("difference")).alias("mean_difference"),
        rnd(lo, 5).alias("low"),
        rnd(hi, 5).alias("high"),
        F.count("difference").alias("n_defined"),
        F.count(F.lit(1)).alias("n_replicates"),
    )
    return rounded(point_differences(spark, sf_dir), 6).join(by, "outcome")


@query(
    "max_t_intervals",
    sql(
        """WITH se AS (SELECT outcome, stddev_samp(difference) AS se FROM rep_diff GROUP BY 1),
t AS (SELECT replicate, max(abs((difference - estimate) / se)) AS m FROM rep_diff JOIN point_diff USING (outcome) JOIN se USING (outcome) GROUP BY 1),
c AS (SELECT quantile_cont(m, 0.95) AS c FROM t)
SELECT outcome, round(estimate, 5) + 0.0 AS estimate, round(se, 5) AS se, round(c, 4) AS critical, round(estimate - c * se, 5) + 0.0 AS low, round(estimate + c * se, 5) + 0.0 AS high,
  round((1 + (SELECT count(*) FROM t WHERE m >= abs(estimate / se))) / (1 + (SELECT count(*) FROM t))::DOUBLE, 6) AS adjusted_p
FROM point_diff JOIN se USING (outcome), c""",
        "rep_diff",
        "point_diff",
    ),
)
def max_t_intervals(spark, sf_dir):
    out = S.max_t(differences(spark, sf_dir), point_differences(spark, sf_dir), "outcome")
    return rounded(rounded(rounded(out, 4, "critical"), 6, "adjusted_p"), 5, "estimate", "se", "low", "high")


@query(
    "two_sided_p_and_holm",
    sql(
        """WITH p AS (SELECT outcome, least(1.0::DOUBLE, 2 * least((1 + count(*) FILTER (WHERE difference <= 0)) / (1 + count(*))::DOUBLE,
    (1 + count(*) FILTER (WHERE difference >= 0)) / (1 + count(*))::DOUBLE)) AS p FROM rep_diff GROUP BY 1)
SELECT outcome, round(p, 6) AS p, round(least(1, max((m - k + 1) * p) OVER (ORDER BY p, outcome)), 6) AS adjusted_p FROM
 (SELECT *, row_number() OVER (ORDER BY p, outcome) AS k, count(*) OVER () AS m FROM p)""",
        "rep_diff",
    ),
)
def two_sided_p_and_holm(spark, sf_dir):
    p = S.two_sided_p(differences(spark, sf_dir), ["outcome"]).withColumn("family", F.lit("paired"))
    return rounded(S.holm(p, ["family"], "p", "outcome").drop("family"))


@query(
    "wilson_intervals",
    sql(
        """SELECT line_no, n, k, round(greatest(0, (k / n::DOUBLE + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((k / n::DOUBLE * (1 - k / n::DOUBLE) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS low,
  round(least(1, (k / n::DOUBLE + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((k / n::DOUBLE * (1 - k / n::DOUBLE) + z * z / (4 * n)) / n) / (1 + z * z / n)), 6) AS high
FROM (SELECT line_no, count(*) AS n, sum(y_any)::BIGINT AS k, 1.959963984540054::DOUBLE AS z FROM scored GROUP BY 1)""",
        "scored",
    ),
)
def wilson_intervals(spark, sf_dir):
    by = scored_lines(spark, sf_dir).groupBy("line_no").agg(F.count(F.lit(1)).alias("n"), F.sum("y_any").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return rounded(by.withColumns({"low": low, "high": high}))
