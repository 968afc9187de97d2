"""Model fits on Spark ML: design table, logistic and boosted candidates, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.values import clip, logit
from strandline.layout import MISSING_LEVEL, UNSEEN_LEVEL
from strandline.operators import isotonic
from strandline.operators.features import NumericState, frozen_level, scaled
from strandline.operators.metrics import binary_metrics
from strandline.session import materialise, scratch_path

# Fixed values: (C, share of the absolute penalty) of the elastic-net candidates.
ELASTIC_GRID = ((0.005, 0.15), (0.010, 0.15), (0.010, 0.50), (0.050, 0.50), (0.050, 0.85))

# Boosted candidates: depth stands in for the number of leaves.
BOOSTED_GRID = (
    {"maxDepth": 4, "minInstancesPerNode": 100, "stepSize": 0.05, "subsamplingRate": 0.8},
    {"maxDepth": 5, "minInstancesPerNode": 100, "stepSize": 0.05, "subsamplingRate": 0.8},
    {"maxDepth": 6, "minInstancesPerNode": 200, "stepSize": 0.03, "subsamplingRate": 0.8},
)


@dataclass
class Candidate:
    name: str
    model: Any
    converged: bool | None = None


def column_sets(static: Sequence[str], **dropped: Sequence[str]) -> dict[str, list[str]]:
    """Named feature subsets: the full list and one list without each dropped group."""
    out = {"full": list(static)}
    out |= {name: [c for c in static if c not in set(gone)] for name, gone in dropped.items()}
    return out


def design_table(df: DataFrame, numeric: Mapping[str, NumericState], levels: Mapping[str, Sequence[str]], bags: Mapping[str, Sequence[str]], out: str = "features") -> DataFrame:
    """Add a feature vector: scaled numbers, one-hot blocks, code presence.

    ``bags`` maps an array column of codes to the codes kept.  One-hot levels and
    codes enter as sparse 0/1 blocks.
    """
    numbers = [c for state in numeric.values() for c in scaled(state)]
    staged, parts, texts = df, [], []
    if numbers:
        staged, parts = staged.withColumn("_numbers", array_to_vector(F.array(*numbers))), ["_numbers"]
    # one-hot blocks are sparse, whatever the number of levels
    blocks = {c: (F.array(frozen_level(c, found)), [*found, MISSING_LEVEL, UNSEEN_LEVEL]) for c, found in levels.items()}
    blocks |= {c: (F.transform(c, lambda x: x.cast("string")), [str(k) for k in kept]) for c, kept in bags.items() if kept}
    for column, (values, words) in blocks.items():
        text, part = f"_text_{column}", f"_part_{column}"
        model = CountVectorizerModel.from_vocabulary(words, inputCol=text, outputCol=part).setBinary(True)
        staged = model.transform(staged.withColumn(text, values))
        parts.append(part)
        texts.append(text)
    return VectorAssembler(inputCols=parts, outputCol=out).transform(staged).drop(*parts, *texts)


def _probability(scored: DataFrame, out: str) -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def logistic(df: DataFrame, y: str, c: float = 1.0, l1_share: float = 0.0, features: str = "features", weight: str | None = None, steps: int = 2000, rows: float | None = None) -> Candidate:
    """Logistic regression with penalty 1/(C n); ``l1_share`` mixes in the absolute penalty.

    The loss is a mean over weights, so n is the sum of the weights, or the number of rows.
    """
    n = rows if rows is not None else df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    options = {"weightCol": weight} if weight else {}
    estimator = LogisticRegression(
        featuresCol=features, labelCol=y, regParam=1.0 / (c * n), elasticNetParam=l1_share,
        standardization=False, maxIter=steps, tol=1e-6, **options,
    )
    model = estimator.fit(df)
    history = model.summary.objectiveHistory
    return Candidate(f"logistic_C{c:g}_l1{l1_share:g}", without_summary(model, df.sparkSession), len(history) - 1 < steps)


def without_summary(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The stored and reloaded model.

    A fresh model holds the summary of its fit, with the training table and whatever
    that refers to; scoring would send all of it to the tasks.
    """
    path = scratch_path(spark, "logistic")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def elastic_net_grid(df: DataFrame, y: str, features: str = "features", grid: Sequence[tuple[float, float]] = ELASTIC_GRID) -> list[Candidate]:
    n = df.count()
    return [logistic(df, y, c, l1, features, steps=1500, rows=n) for c, l1 in grid]


def boosted_grid(df: DataFrame, y: str, is_validation: str, features: str = "features", grid: Sequence[Mapping[str, Any]] = BOOSTED_GRID, rounds: int = 300, seed: int = 17) -> list[Candidate]:
    """Boosted trees that stop once the marked validation rows no longer improve at all.

    ``rounds`` is a bound, not the rule: a validation error that falls by less than
    the tolerance ends a fit.
    """
    out = []
    for number, options in enumerate(grid):
        estimator = GBTClassifier(
            featuresCol=features, labelCol=y, maxIter=rounds, seed=seed,
            validationIndicatorCol=is_validation, validationTol=1e-5, maxBins=127, **options,
        )
        out.append(Candidate(f"boosted_{number}", estimator.fit(df)))
    return out


def score(candidate: Candidate, df: DataFrame, out: str = "p") -> DataFrame:
    return _probability(candidate.model.transform(df), out)


def optimality(candidate: Candidate, df: DataFrame, y: str, c: float = 1.0, l1_share: float = 0.0, features: str = "features") -> dict[str, Any]:
    """How far a fitted logistic model is from the minimum of its convex loss.

    At the minimum the slope of the loss along each weight is met by the penalty: it
    is minus the penalty's slope where the weight is not zero, and no larger than the
    absolute penalty where it is.  ``violation`` is the largest gap over all weights
    and the intercept, for the mean loss with penalty 1/(C n).
    """
    spark = df.sparkSession
    weights = spark.createDataFrame(list(enumerate(map(float, candidate.model.coefficients))), "place int, w double")
    vector = F.unwrap_udt(features)
    rows = materialise(score(candidate, df).select((F.col("p") - F.col(y)).alias("e"), vector.alias("v")), "residuals")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean")).first()
    n = facts["n"]
    cells = rows.select("e", F.col("v.indices").alias("at"), F.posexplode("v.values").alias("k", "x"))
    place = F.coalesce(F.get("at", F.col("k")), F.col("k"))
    slopes = cells.groupBy(place.alias("place")).agg((F.sum(F.col("e") * F.col("x")) / n).alias("slope"))
    penalty = 1.0 / (c * n)
    w, bound = F.col("w"), F.lit(penalty * l1_share)
    slope = F.coalesce("slope", F.lit(0.0)) + F.lit(penalty * (1 - l1_share)) * w
    gap = F.when(w == 0, F.greatest(F.abs(slope) - bound, F.lit(0.0))).otherwise(F.abs(slope + bound * F.signum(w)))
    found = weights.join(slopes, "place", "left").agg(
        F.count(F.lit(1)).cast("int").alias("features"), F.max(gap).alias("largest"), F.count_if(w != 0).alias("used")
    ).first()
    return {
        "features": found["features"], "n_rows": n, "used": found["used"], "violation": max(found["largest"], abs(facts["mean"])),
    }


def validity(scored: DataFrame, p: str, y: str, converged: bool | None) -> dict[str, Any]:
    """Gates a candidate must pass: finite, not constant, AUROC at least 0.5, converged."""
    v = F.col(p)
    finite = v.isNotNull() & ~F.isnan(v)
    facts = scored.agg(
        F.every(finite).alias("finite"), (F.max(v) - F.min(v)).alias("range"), F.stddev_pop(v).alias("sd")
    ).first()
    metrics = binary_metrics(scored, [], p, y).first() if facts["finite"] else None
    auroc = metrics["auroc"] if metrics else None
    varied = bool(facts["finite"] and facts["range"] > 1e-7 and facts["sd"] > 1e-8)
    reasons = []
    if not facts["finite"]:
        reasons.append("nonfinite_predictions")
    if not varied:
        reasons.append("degenerate_prediction_distribution")
    if converged is False:
        reasons.append("optimizer_not_converged")
    if auroc is None or auroc < 0.5:
        reasons.append("inverse_or_undefined_ranking")
    return {
        "auroc": auroc,
        "auprc": metrics["auprc"] if metrics else None,
        "brier": metrics["brier"] if metrics else None,
        "valid": not reasons,
        "reasons": reasons,
    }


def choose(candidates: Sequence[Candidate], rows: DataFrame, y: str) -> tuple[Candidate, list[dict[str, Any]]]:
    """Valid candidate with the highest average precision; lower Brier, then grid order, at ties."""
    reports = []
    for number, candidate in enumerate(candidates):
        reports.append({"name": candidate.name, "order": number, **validity(score(candidate, rows), "p", y, candidate.converged)})
    valid = [r for r in reports if r["valid"]]
    if not valid:
        raise ValueError(f"no valid candidate: {reports}")
    best = min(valid, key=lambda r: (-r["auprc"], r["brier"], r["order"]))
    return candidates[best["order"]], reports


def linear_score(df: DataFrame, key: str, codes: str, coefficients: DataFrame, intercept: float, out: str = "p") -> DataFrame:
    """sigmoid(sum of code weights + intercept) from a stored table (code, weight)."""
    from strandline.operators.skew import lookup_join

    present = df.select(key, F.explode(F.array_distinct(codes)).alias("code"))
    sums = lookup_join(present, coefficients, ["code"], "inner").groupBy(key).agg(F.sum("weight").alias("_s"))
    total = F.coalesce("_s", F.lit(0.0)) + F.lit(float(intercept))
    return df.join(sums, key, "left").withColumn(out, 1 / (1 + F.exp(-total))).drop("_s")


# calibration ----------------------------------------------------------------

def fit_platt(df: DataFrame, p: str, y: str, weight: str | None = None) -> tuple[float, float]:
    """Intercept and slope of an unpenalised logistic fit on logit(p)."""
    options = {"weightCol": weight} if weight else {}
    rows = df.withColumn("_x", array_to_vector(F.array(logit(F.col(p)))))
    model = LogisticRegression(featuresCol="_x", labelCol=y, regParam=0.0, maxIter=1000, tol=1e-12, **options).fit(rows)
    return float(model.intercept), float(model.coefficients[0])


def apply_calibrator(df: DataFrame, method: str, fitted: Any, p: str, out: str) -> DataFrame:
    if method == "none":
        return df.withColumn(out, clip(F.col(p)))
    if method == "platt":
        a, b = fitted
        return df.withColumn(out, 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * logit(F.col(p))))))
    return isotonic.apply(df.withColumn("_clipped", clip(F.col(p))), fitted, "_clipped", out).drop("_clipped")


def fit_calibrator(df: DataFrame, method: str, p: str, y: str) -> Any:
    if method == "none":
        return None
    if method == "platt":
        return fit_platt(df, p, y)
    return isotonic.fit(df.withColumn("_clipped", clip(F.col(p))), "_clipped", y)


def choose_calibrator(df: DataFrame, p: str, y: str, half: str, tolerance: float = 0.0005) -> tuple[str, Any, dict[str, float]]:
    """Fit on half 0, compare Brier on half 1, take the simplest within the tolerance, refit on all."""
    fit, rest = df.where(F.col(half) == 0), df.where(F.col(half) == 1)
    if fit.isEmpty() or rest.isEmpty():
        raise ValueError("the nested split left one half empty")
    brier = {}
    for method in ("none", "platt", "isotonic"):
        scored = apply_calibrator(rest, method, fit_calibrator(fit, method, p, y), p, "_c")
        brier[method] = scored.agg(F.avg(F.pow(F.col("_c") - F.col(y), F.lit(2.0)))).first()[0]
    best = min(brier.values())
    method = next(m for m in brier if brier[m] <= best + tolerance)
    return method, fit_calibrator(df, method, p, y), brier


# frozen artefacts -------------------------------------------------------------

def save_model(candidate: Candidate, path: str) -> None:
    PipelineModel([candidate.model]).write().save(path)


def batch_score(df: DataFrame, path: str, out: str = "p") -> DataFrame:
    """Score with a stored pipeline; a probability outside [0, 1] stops the job."""
    scored = _probability(PipelineModel.load(path).transform(df), out)
    p = F.col(out)
    ok = (p >= 0) & (p <= 1)
    return scored.withColumn(out, F.when(ok, p).otherwise(F.raise_error(F.lit("probability out of range")).cast("double")))


__all__ = [
    "BOOSTED_GRID", "ELASTIC_GRID", "Candidate", "apply_calibrator", "batch_score", "boosted_grid",
    "choose", "choose_calibrator", "column_sets", "design_table", "elastic_net_grid", "fit_calibrator", "fit_platt",
    "linear_score", "logistic", "optimality", "save_model", "score", "validity",
]
