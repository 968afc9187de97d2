"""Model-fit jobs: design table, candidates, calibration, frozen scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.ids import hash_bits, nested_half
from strandline.functions.values import clip
from strandline.operators import metrics as M
from strandline.operators import models
from strandline.operators.codes import frequent_codes
from strandline.operators.features import fit_levels, fit_numeric
from strandline.operators.joins import checked_join
from strandline.plans.bindings import encoded, scored_documents, scored_lines
from strandline.plans.evaluation import metrics_sql, newton_sql
from strandline.plans.linkage import episodes, histories, index_rule
from strandline.plans.registry import cte, query, rounded, sql
from strandline.plans.stages import planned, staged
from strandline.session import materialise, scratch_path

NUMERIC = (
    "age", "severity", "risk", "stay", "charge", "prior_count_ytd", "prior_count_180d", "prior_emergency_180d",
    "prior_stay_sum_180d", "days_since_prior",
)
CATEGORICAL = ("female", "payer")
BAGS = ("dx_ids", "pr_ids")
MINIMUM = 20
GROUPS = {"no_prior": [c for c in NUMERIC if c.startswith("prior_") or c == "days_since_prior"], "no_payer": ["payer"]}


@staged
def model_rows(spark, sf_dir):
    """Eligible index encounters with every input column and the outcome.

    The outcome is the planned state, which the codes can tell; in the driver
    tables follow-up is independent of every input.
    """
    index = episodes(spark, sf_dir).where("eligible").select(
        "enc_id", "year", "age", "severity", "risk", "stay", "charge", "female", "payer",
        (F.col("planned_status") == 1).cast("int").alias("y"),
    )
    history = histories(spark, sf_dir).select("enc_id", *[c for c in NUMERIC if c.startswith("prior_") or c == "days_since_prior"])
    # of all encounters only those that pass the rule before their next gap is known can be an index
    known = encoded(spark, sf_dir).withColumn("next_gap", F.lit(None).cast("int"))
    codes = known.select("enc_id", *BAGS, index_rule().alias("_index"))
    return checked_join(checked_join(index, history, ["enc_id"]), codes, ["enc_id"], within=F.col("_index")).drop("_index")


def split(rows):
    return rows.where("year <= 1998"), rows.where("year > 1998")


def design(spark, sf_dir, columns=None, bags=BAGS, minimum=MINIMUM):
    """Feature vectors; all state is fitted on the development years."""
    rows = model_rows(spark, sf_dir)
    columns = columns if columns is not None else [*NUMERIC, *CATEGORICAL]
    development, _ = split(rows)
    numeric = fit_numeric(development, [c for c in NUMERIC if c in columns])
    levels = fit_levels(development, [c for c in CATEGORICAL if c in columns])
    kept = {b: [r["id"] for r in frequent_codes(development, b, minimum).orderBy("id").collect()] for b in bags}
    return models.design_table(rows, numeric, levels, kept)


@staged
def full_design(spark, sf_dir):
    return design(spark, sf_dir).select("enc_id", "year", "y", "features")


_PRIOR = [c for c in NUMERIC if c.startswith("prior_") or c == "days_since_prior"]
_PLAIN = [c for c in NUMERIC if c not in _PRIOR]
cte(
    "model_rows",
    f"""SELECT e.enc_id, e.year, {', '.join(f'e.{c}::DOUBLE AS {c}' for c in _PLAIN)}, {', '.join(f'h.{c}::DOUBLE AS {c}' for c in _PRIOR)},
  e.female, e.payer, (e.planned_status = 1)::INT AS y, c.dx_ids, c.pr_ids
FROM eps e JOIN hist h USING (enc_id) JOIN encoded c USING (enc_id) WHERE e.eligible""",
    "hist",
    "encoded",
)
cte(
    "kept_ids",
    f"""SELECT side, id FROM (SELECT 'dx' AS side, enc_id, unnest(dx_ids) AS id FROM model_rows WHERE year <= 1998
  UNION ALL SELECT 'pr', enc_id, unnest(pr_ids) FROM model_rows WHERE year <= 1998) WHERE id > 3 GROUP BY 1, 2 HAVING count(DISTINCT enc_id) >= {MINIMUM}""",
    "model_rows",
)
cte(
    "row_ids",
    """SELECT enc_id, count(*) AS n FROM (SELECT DISTINCT enc_id, side, id FROM (SELECT enc_id, 'dx' AS side, unnest(dx_ids) AS id FROM model_rows
  UNION ALL SELECT enc_id, 'pr', unnest(pr_ids) FROM model_rows)) JOIN kept_ids USING (side, id) GROUP BY 1""",
    "kept_ids",
)


@query(
    "sparse_design_table",
    sql(
        f"""WITH med AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in NUMERIC)} FROM model_rows WHERE year <= 1998)
SELECT r.enc_id, r.y, (2 * {len(NUMERIC)} + (SELECT count(DISTINCT female) + 2 + count(DISTINCT payer) + 2 FROM model_rows WHERE year <= 1998)
    + (SELECT count(*) FROM kept_ids))::INT AS width,
  ({' + '.join(f'(r.{c} IS NULL OR r.{c} <> med.{c})::INT' for c in NUMERIC)} + 2 + coalesce(i.n, 0))::INT AS filled
FROM model_rows r LEFT JOIN row_ids i USING (enc_id), med""",
        "model_rows",
        "row_ids",
    ),
)
def sparse_design_table(spark, sf_dir):
    """Size and number of filled cells of every feature vector."""
    vector = F.unwrap_udt("features")  # a sparse vector names its size, a dense one is as wide as its values
    return full_design(spark, sf_dir).select(
        "enc_id",
        "y",
        F.coalesce(vector["size"], F.size(vector["values"])).alias("width"),
        F.size(F.filter(vector["values"], lambda x: x != 0)).alias("filled"),
    )


@staged
def logistic_scores(spark, sf_dir):
    development, _ = split(full_design(spark, sf_dir))
    fitted = models.logistic(development, "y", c=1.0)
    return models.score(fitted, full_design(spark, sf_dir)).select("enc_id", "year", "y", "p")


@query("logistic_l2_scores")
def logistic_l2_scores(spark, sf_dir):
    return rounded(logistic_scores(spark, sf_dir))


def report(spark, reports, chosen):
    rows = [
        (r["name"], r["auroc"], r["auprc"], r["brier"], r["valid"], ";".join(r["reasons"]), r["name"] == chosen.name) for r in reports
    ]
    return spark.createDataFrame(
        rows, "name string, auroc double, auprc double, brier double, valid boolean, reasons string, chosen boolean"
    )


@planned
def elastic_candidates(spark, sf_dir):
    development, _ = split(full_design(spark, sf_dir))
    return models.elastic_net_grid(development, "y")


@query("elastic_net_grid")
def elastic_net_grid(spark, sf_dir):
    """Five penalty settings; the valid one with the highest average precision wins."""
    _, later = split(full_design(spark, sf_dir))
    chosen, reports = models.choose(elastic_candidates(spark, sf_dir), later, "y")
    return rounded(report(spark, reports, chosen))


_DESIGN_SIZE = f"""(2 * {len(NUMERIC)} + (SELECT count(DISTINCT female) + 2 + count(DISTINCT payer) + 2 FROM model_rows WHERE year <= 1998)
  + (SELECT count(*) FROM kept_ids))::INT AS features, (SELECT count(*) FROM model_rows WHERE year <= 1998) AS n_rows"""
SLOPE_GAP = 1e-4  # of a mean loss


@query(
    "elastic_net_optimal",
    sql(
        " UNION ALL ".join(f"SELECT 'logistic_C{c:g}_l1{l1:g}' AS name, {_DESIGN_SIZE}, true AS optimal" for c, l1 in models.ELASTIC_GRID),
        "model_rows",
        "kept_ids",
    ),
)
def elastic_net_optimal(spark, sf_dir):
    """Every fit of the grid meets the conditions of the minimum of its penalised loss."""
    development, _ = split(full_design(spark, sf_dir))
    rows = []
    for candidate, (c, l1) in zip(elastic_candidates(spark, sf_dir), models.ELASTIC_GRID):
        found = models.optimality(candidate, development, "y", c, l1)
        rows.append((candidate.name, found["features"], found["n_rows"], found["violation"] < SLOPE_GAP))
    return spark.createDataFrame(rows, "name string, features int, n_rows long, optimal boolean")


@query("boosted_trees_grid")
def boosted_trees_grid(spark, sf_dir):
    """Three boosted settings, stopped early on the last development year."""
    development, later = split(full_design(spark, sf_dir))
    marked = development.withColumn("is_validation", F.col("year") == 1998)
    candidates = models.boosted_grid(marked, "y", "is_validation")
    chosen, reports = models.choose(candidates, later, "y")
    return rounded(report(spark, reports, chosen))


_CASES = {"sound": "p_fine", "constant": "0.3::DOUBLE", "reversed": "1 - p_fine"}
cte(
    "cases",
    " UNION ALL ".join(f"SELECT '{n}' AS name, y_any AS y, {p} AS p FROM scored" for n, p in _CASES.items()),
    "scored",
)


@query(
    "candidate_validity",
    sql(
        f"""SELECT name, auroc, spread > 1e-7 AND auroc >= 0.5 AS valid,
  concat_ws(';', CASE WHEN spread <= 1e-7 THEN 'degenerate_prediction_distribution' END, CASE WHEN auroc < 0.5 THEN 'inverse_or_undefined_ranking' END) AS reasons
FROM ({metrics_sql("cases", "name", "1.0::DOUBLE")}) JOIN (SELECT name, max(p) - min(p) AS spread FROM cases GROUP BY 1) USING (name)""",
        "cases",
    ),
)
def candidate_validity(spark, sf_dir):
    """Gates on a sound score, a constant one and a reversed one."""
    rows = materialise(scored_lines(spark, sf_dir).select(F.col("y_any").alias("y"), F.col("p_fine").alias("p")), "scores")
    cases = {"sound": F.col("p"), "constant": F.lit(0.3), "reversed": 1 - F.col("p")}
    out = []
    for name, p in cases.items():
        found = models.validity(rows.withColumn("q", p), "q", "y", True)
        out.append((name, found["auroc"], found["valid"], ";".join(found["reasons"])))
    return rounded(spark.createDataFrame(out, "name string, auroc double, valid boolean, reasons string"))


cte(
    "doc_logits",
    """SELECT 1 AS g, ln(p / (1 - p)) AS x, sum(weight * y) AS pos, sum(weight * (1 - y)) AS neg FROM
  (SELECT * REPLACE (least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS p) FROM docs) GROUP BY 1, 2""",
    "docs",
)


@query(
    "platt_fit",
    sql(
        "SELECT round(calibration_intercept, 3) + 0.0 AS intercept, round(calibration_slope, 3) + 0.0 AS slope FROM ("
        + sql(newton_sql("doc_logits", "g", 15), "doc_logits")
        + ")"
    ),
)
def platt_fit(spark, sf_dir):
    intercept, slope = models.fit_platt(scored_documents(spark, sf_dir), "p", "y", "weight")
    return rounded(spark.createDataFrame([(intercept, slope)], "intercept double, slope double"), 3)


_CLIP = "least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE)"


def isotonic_sql(source: str) -> str:
    """Monotone means of y by distinct score: the largest over starts of the smallest mean over ends."""
    return f"""SELECT f, max(low) AS g FROM (
  SELECT a.f AS start, b.f, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)::DOUBLE) OVER (PARTITION BY a.f ORDER BY b.f DESC ROWS UNBOUNDED PRECEDING) AS low
  FROM points a JOIN points b ON a.f <= b.f) GROUP BY 1""".replace(
        "points", f"(SELECT *, sum(n) OVER (ORDER BY f) AS cn, sum(s) OVER (ORDER BY f) AS cs FROM (SELECT {_CLIP} AS f, count(*) AS n, sum(y) AS s FROM {source} GROUP BY 1))"
    )


@query(
    "isotonic_calibration",
    sql(f"SELECT doc_id, p, round(g, 6) AS calibrated FROM docs JOIN ({isotonic_sql('docs')}) ON f = {_CLIP}", "docs"),
)
def isotonic_calibration(spark, sf_dir):
    rows = scored_documents(spark, sf_dir)
    fitted = models.fit_calibrator(rows, "isotonic", "p", "y")
    out = models.apply_calibrator(rows, "isotonic", fitted, "p", "calibrated")
    return rounded(out.select("doc_id", "p", "calibrated"))


cte(
    "halves",
    f"""SELECT doc_id, y, {_CLIP} AS p, ((('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT >> 1) & 1)::INT AS half FROM docs""",
    "docs",
)
cte("half_logits", "SELECT 1 AS g, ln(p / (1 - p)) AS x, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM halves WHERE half = 0 GROUP BY 1, 2", "halves")


@query(
    "calibrator_choice",
    sql(
        f"""WITH iso AS ({isotonic_sql("(SELECT * FROM halves WHERE half = 0)")}),
platt AS ({sql(newton_sql("half_logits", "g", 15).replace(", 5)", ", 12)"), "half_logits")}),
later AS (SELECT * FROM halves WHERE half = 1),
smooth AS (SELECT l.*, CASE WHEN lo.f IS NULL THEN hi.g WHEN hi.f IS NULL OR hi.f = lo.f THEN lo.g ELSE lo.g + (hi.g - lo.g) * (l.p - lo.f) / (hi.f - lo.f) END AS c
  FROM later l ASOF LEFT JOIN iso lo ON l.p >= lo.f ASOF LEFT JOIN iso hi ON l.p <= hi.f),
b AS (SELECT 1 AS place, 'none' AS method, avg((p - y) ** 2) AS brier FROM later
  UNION ALL SELECT 2, 'platt', avg((1 / (1 + exp(-(calibration_intercept + calibration_slope * ln(p / (1 - p))))) - y) ** 2) FROM later, platt
  UNION ALL SELECT 3, 'isotonic', avg((c - y) ** 2) FROM smooth)
SELECT method, round(brier, 4) AS brier, place = (SELECT min(place) FROM b WHERE brier <= (SELECT min(brier) FROM b) + 0.0005::DOUBLE) AS chosen FROM b""",
        "halves",
    ),
)
def calibrator_choice(spark, sf_dir):
    """Fit on one half, compare on the other, keep the simplest within the tolerance."""
    rows = materialise(
        scored_documents(spark, sf_dir).withColumn("half", nested_half(hash_bits(F.col("doc_id").cast("string")))), "halves"
    )
    method, _, brier = models.choose_calibrator(rows, "p", "y", "half")
    table = [(name, value, name == method) for name, value in brier.items()]
    return rounded(spark.createDataFrame(table, "method string, brier double, chosen boolean"), 4)


@query("logistic_l2_stationary", sql(f"SELECT {_DESIGN_SIZE}, true AS stationary", "model_rows", "kept_ids"))
def logistic_l2_stationary(spark, sf_dir):
    """The slope of the penalised loss is zero at the fitted weights, so they are the minimum."""
    development, _ = split(full_design(spark, sf_dir))
    found = models.optimality(models.logistic(development, "y", c=1.0), development, "y")
    row = (found["features"], found["n_rows"], found["violation"] < SLOPE_GAP)
    return spark.createDataFrame([row], "features int, n_rows long, stationary boolean")


@query("frozen_batch_scoring")
def frozen_batch_scoring(spark, sf_dir):
    """Fit, store, load, score the later years, calibrate with frozen numbers."""
    development, later = split(full_design(spark, sf_dir))
    path = scratch_path(spark, "model")
    models.save_model(models.logistic(development, "y", c=0.1), path)
    a, b = models.fit_platt(models.batch_score(development, path), "p", "y")
    scored = models.batch_score(later, path)
    out = models.apply_calibrator(scored, "platt", (a, b), "p", "calibrated")
    return rounded(out.select("enc_id", clip(F.col("p")).alias("p"), "calibrated"))


@query("ablation_column_sets")
def ablation_column_sets(spark, sf_dir):
    """The same fit on feature subsets, compared on the later years."""
    sets = models.column_sets([*NUMERIC, *CATEGORICAL], **GROUPS)
    parts = []
    for name, columns in sets.items():
        development, later = split(design(spark, sf_dir, columns))
        fitted = models.logistic(development, "y", c=1.0)
        scored = models.score(fitted, later).select("enc_id", "y", "p").withColumn("columns", F.lit(name))
        parts.append(scored)
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return rounded(M.binary_metrics(together, ["columns"], "p", "y"))
