import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import conformal as P
from strandline.operators import contracts as K
from strandline.operators import disclosure as X
from strandline.operators import drift as D
from strandline.operators import joins as J
from strandline.operators import models
from strandline.operators.ordering import order_statistic
from strandline.session import scratch_path
from strandline.sources import readers as R
from strandline.sources import writers as W


# prediction sets ------------------------------------------------------------------

@pytest.mark.parametrize("n,alpha", [(1, 0.5), (7, 0.25), (23, 0.1), (40, 0.03)])
def test_cutoff_is_the_conformal_order_statistic(spark, n, alpha):
    rng = random.Random(n)
    values = [round(rng.random(), 3) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    # the smallest value with at least (n + 1)(1 - alpha) values at or below it, the largest if there is none
    want = next((v for v in sorted(values) if sum(x <= v for x in values) >= (n + 1) * (1 - alpha) - 1e-9), max(values))
    assert order_statistic(df, [], "s", lambda k: P.sample_rank(k, alpha)).first()["value"] == want


def masks(spark, rows, q):
    df = spark.createDataFrame([(r,) for r in rows], "p array<double>")
    return [r[0] for r in df.select(P.set_mask(F.col("p"), F.lit(q), len(rows[0]))).collect()]


@pytest.mark.parametrize("q", [0.05, 0.45, 0.75, 0.99])
def test_sets_hold_every_likely_class_and_never_none(spark, q):
    rng = random.Random(17)
    rows = []
    for _ in range(60):
        raw = [rng.random() ** 3 for _ in range(4)]
        rows.append([x / sum(raw) for x in raw])
    rows.append([0.25] * 4)  # a tie takes the first class
    for row, mask in zip(rows, masks(spark, rows, q)):
        chosen = {k for k, x in enumerate(row) if x >= 1 - q} or {row.index(max(row))}
        assert {k for k in range(4) if mask >> k & 1} == chosen


def test_small_groups_take_the_global_cutoff(spark):
    rng = random.Random(29)
    rows = [(round(rng.random(), 4), g) for g, n in (("x", 30), ("y", 11), ("z", 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "s double, g string")
    cut = {(r["dimension"], r["level"]): r for r in P.cutoffs(df, "s", {"g": F.col("g")}, [0.15], min_rows=11).collect()}

    def plain(values):
        values = sorted(values)
        return values[min(len(values), math.ceil((len(values) + 1) * 0.85)) - 1]

    whole = plain(v for v, _ in rows)
    assert cut["ALL", "ALL"]["q"] == whole
    for g, n in (("x", 30), ("y", 11), ("z", 10)):
        own = n >= 11
        assert cut["g", g]["q"] == (plain(v for v, k in rows if k == g) if own else whole)
        assert (cut["g", g]["status"] == "CALIBRATED") is own


def test_invalid_class_scores_stop(spark):
    df = spark.createDataFrame([(0.2, -0.1)], "a double, b double")
    with pytest.raises(Exception, match="class scores"):
        df.select(P.normalise_scores([F.col("a"), F.col("b")])).collect()


# contracts ------------------------------------------------------------------------

def test_checked_join_fails_closed(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, e string")
    with pytest.raises(J.JoinContractError, match="repeats"):
        J.checked_join(left, left.union(left), ["k"])
    with pytest.raises(J.JoinContractError, match="no partner"):
        J.checked_join(left, left.where("k = 1"), ["k"], agree=["e"])
    with pytest.raises(J.JoinContractError, match="disagree"):
        J.checked_join(left, left.withColumn("e", F.lit("z")), ["k"], agree=["e"])
    assert J.checked_join(left, left.where("k = 1").drop("e"), ["k"], orphans=True).count() == 2


def test_contracts_fail_closed(spark):
    df = spark.createDataFrame([(1, 2022, "test", 0.5), (2, 2021, "test", 1.5)], "k int, year int, part string, p double")
    with pytest.raises(K.ContractError):
        K.require(df, {"p": K.is_probability(F.col("p"))})
    with pytest.raises(K.ContractError):
        K.require_partition(df, "year", [2022], "part", "test", "k")
    with pytest.raises(K.ContractError):
        K.require_schema(df, T.StructType([T.StructField("k", T.LongType())]))
    with pytest.raises(K.ContractError):
        K.require_no_columns(df.withColumnRenamed("k", "subject_id"))
    with pytest.raises(K.ContractError):
        K.require_same_count(df, df.where("k = 1"))
    sets = spark.createDataFrame([(3, 2, False), (1, 1, True), (40, 2, True)], "m int, s int, a boolean")
    found = K.violations(sets, K.set_rules("m", "s", "a")).first()
    assert (found["m_range"], found["s_is_bit_count"], found["a_covers_non_singletons"]) == (1, 0, 1)


def test_fingerprint_ignores_row_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert K.fingerprint(df).first() == K.fingerprint(df.orderBy(F.desc("k"))).first()
    assert K.fingerprint(df).first() != K.fingerprint(df.fillna("")).first()


# drift -----------------------------------------------------------------------------

def test_null_labels_only_where_allowed(spark):
    df = spark.createDataFrame([(1.0, 1, None), (1.0, 0, 1)], "w double, a int, b int")
    with pytest.raises(K.ContractError, match="fully observed"):
        D.labels_long(df, ["a", "b"], ["w"])
    rates = {(r["outcome"], r["weighting"]): r for r in D.label_rates(D.labels_long(df, ["a", "b"], ["w"], ["b"]), "w").collect()}
    assert rates[("b", "unweighted_rate")]["rate"] == 1.0 and rates[("b", "unweighted_rate")]["missing_n"] == 1


def test_undeclared_level_fails(spark):
    observed = spark.createDataFrame([("d", "new", 1, 1, 0.5, 1.0, 0.1)], "dimension string, level string, n_rows long, event_count long, coverage double, mean_set_size double, abstention_rate double")
    reference = spark.createDataFrame([("d", "old", 0.5, 1.0, 0.1)], "dimension string, level string, coverage double, mean_set_size double, abstention_rate double")
    none = spark.createDataFrame([], "dimension string, level string")
    with pytest.raises(Exception, match="undeclared level"):
        D.coverage_drift(observed, reference, ["dimension", "level"], none).collect()
    declared = spark.createDataFrame([("d", "new")], "dimension string, level string")
    out = {r["level"]: r["status"] for r in D.coverage_drift(observed, reference, ["dimension", "level"], declared).collect()}
    assert out == {"new": "NO_FROZEN_REFERENCE_NEW_STRATUM", "old": "UNDEFINED_EMPTY_SUBGROUP"}


# disclosure -------------------------------------------------------------------------

def test_suppression(spark):
    rng = random.Random(31)
    number = lambda: rng.choice([None, 0, 3, X.LIMIT, X.LIMIT + 1, 500])
    rows = [(f"row{i}", *(number() for _ in X.TRIGGER_COUNTS), rng.random(), "FINE") for i in range(80)]
    counts = ", ".join(f"{c} int" for c in X.TRIGGER_COUNTS)
    df = spark.createDataFrame(rows, f"outcome string, {counts}, auroc double, status string")
    public = {r["outcome"]: r for r in X.suppress(df).collect()}
    audit = {r["row_key"]: r["trigger_fields"].split(";") for r in X.suppression_audit(df, ["outcome"]).collect()}
    for name, *numbers, auroc, status in rows:
        fired = [c for c, n in zip(X.TRIGGER_COUNTS, numbers) if n is not None and n <= X.LIMIT]
        shown = [public[name][c] for c in X.TRIGGER_COUNTS]
        if fired:
            assert audit[f"outcome={name}"] == fired and shown == [None] * len(numbers)
            assert public[name]["auroc"] is None and public[name]["status"] == X.SUPPRESSED
        else:
            assert f"outcome={name}" not in audit and shown == numbers
            assert (public[name]["auroc"], public[name]["status"]) == (auroc, status)
    assert X.unsuppressed_counts(X.suppress(df)).isEmpty() and not X.unsuppressed_counts(df).isEmpty()
    with pytest.raises(K.ContractError):
        X.check_public_columns(df.withColumn("hospital_hash", F.lit("x")))


# sources ------------------------------------------------------------------------------

def text_file(spark, lines):
    path = scratch_path(spark, "text")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_short_rows_stop_and_long_rows_are_repaired(spark):
    ok = R.read_ragged(spark, text_file(spark, ["a,b,c", "a,b,c, d,e"]), ["x", "y", "z"]).collect()
    assert [r["z"] for r in ok] == ["c", "c, d,e"]
    with pytest.raises(Exception, match="short row"):
        R.read_ragged(spark, text_file(spark, ["a,b"]), ["x", "y", "z"]).collect()


def test_json_object_stream(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StructType([T.StructField("c", T.StringType())]))])
    lines = ["{", '  "a": 1,', '  "b": {', '    "c": "}"', "  }", "}", "{", '  "a": 2', "}"]
    out = R.read_json_objects(spark, text_file(spark, lines), schema).orderBy("a").collect()
    assert [(r["a"], r["b"]["c"] if r["b"] else None) for r in out] == [(1, "}"), (2, None)]
    with pytest.raises(Exception):
        R.read_json_objects(spark, text_file(spark, ["[1, 2]"]), schema).collect()


def test_malformed_numbers_stop_a_typed_read(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    with pytest.raises(Exception):
        R.read_delimited(spark, text_file(spark, ["x"]), schema).collect()


def test_empty_entity_list_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        R.read_related(df, df.where("k = 2"), ["k"])


def test_publish_refuses_leftovers(spark):
    path = scratch_path(spark, "out")
    df = spark.range(3)

    def fail(p):
        W.write_table(df, p)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        W.publish(spark, path, fail)
    with pytest.raises(W.AlreadyPublished):
        W.publish(spark, path, lambda p: W.write_table(df, p))


# models --------------------------------------------------------------------------------

def test_candidates_pass_every_gate_or_name_the_failed_ones(spark):
    rng = random.Random(37)
    rows = [(y, 0.3 + 0.4 * y + rng.uniform(-0.2, 0.2)) for y in (0, 1) for _ in range(50)]
    df = spark.createDataFrame(rows, "y int, p double")
    reasons = lambda p, done=True: set(models.validity(df.withColumn("q", p), "q", "y", converged=done)["reasons"])
    assert reasons(F.col("p")) == set() and reasons(F.col("p"), None) == set()
    assert reasons(F.col("p"), False) == {"optimizer_not_converged"}
    assert reasons(1 - F.col("p")) == {"inverse_or_undefined_ranking"}
    assert "degenerate_prediction_distribution" in reasons(F.lit(0.4))
    assert "nonfinite_predictions" in reasons(F.lit(float("nan")))


@pytest.mark.parametrize("p", [0.0, 1e-9, 3e-7, 0.37, 1 - 3e-8, 1.0])
def test_no_calibrator_only_clips(spark, p):
    df = spark.createDataFrame([(p,)], "p double")
    assert models.apply_calibrator(df, "none", None, "p", "c").first()["c"] == min(max(p, 1e-7), 1 - 1e-7)
