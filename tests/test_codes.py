import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import ids, text
from strandline.functions import values as V
from strandline.operators import codes as C
from strandline.operators import features


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_normalising(spark):
    null = F.lit(None).cast("string")
    r = one(spark, text.normalize_code(F.lit(" a12.34 ")), text.normalize_code(null), text.normalize_category(F.lit("5.0")),
            text.strip_quotes(F.lit(" 'x' ")), text.collapse_blanks(F.lit(" a \t b ")))
    assert tuple(r) == ("A1234", "", "5", "x", "a b")


def test_year_scoped_ids(spark):
    r = one(spark, *[ids.year_scoped_id(F.lit(y), F.lit("abc")) for y in (2018, 2018, 2019)])
    assert r[0] == r[1] != r[2]


def test_vocabulary_freezes_and_marks_unseen(spark):
    rows = spark.createDataFrame([(1, 2020, ["AB1.0", "AB11", None]), (2, 2021, ["AB10", "newcode", None])], "k int, year int, codes array<string>")
    vocabulary = C.fit_vocabulary(C.code_rows(rows, ["year"], "codes"), "year", [2020])
    known = {r["code"]: r["id"] for r in vocabulary.collect()}
    assert known == {"AB10": 4, "AB11": 5}
    out = {r["k"]: r["ids"] for r in C.encode_array(rows, "k", "codes", vocabulary, "ids").collect()}
    assert out == {1: [4, 5, 3], 2: [4, 2, 3]}
    audit = C.unseen_audit(C.encode_rows(C.code_rows(rows, ["k"], "codes"), vocabulary)).collect()
    assert [(r["code"], r["n"]) for r in audit] == [("NEWCODE", 1)]
    assert tuple(C.vocabulary_faults(vocabulary).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("minimum", [1, 4, 9, 100])
def test_frequent_codes_count_rows_not_repeats(spark, minimum):
    rng = random.Random(53)
    rows = [[rng.randrange(0, 16) for _ in range(rng.randrange(0, 7))] for _ in range(40)]
    df = spark.createDataFrame([(r,) for r in rows], "ids array<int>")
    counts = {i: sum(i in r for r in rows) for i in range(4, 16)}
    kept = sorted(i for i, n in counts.items() if n >= minimum)
    got = {r["id"]: (r["n"], r["column"]) for r in C.frequent_codes(df, "ids", minimum).collect()}
    assert got == {i: (counts[i], place) for place, i in enumerate(kept)}


@pytest.mark.parametrize(
    "principal,procedures,status",
    [
        ("DX4", ["PR1"], 1), ("DX2", ["PR0"], 1), ("DX0", ["PR3"], 1), ("DX4", ["PR3"], 0), ("DX0", ["PR0"], 0),
        ("UNKNOWN", ["PR0"], -1), ("DX0", ["UNKNOWN"], -1), (None, ["PR0"], -1), ("", [], -1), ("DX0", [], 0),
    ],
)
def test_planned_rule(spark, principal, procedures, status):
    row = spark.createDataFrame([(principal, procedures)], "d string, p array<string>")
    sets = {"p1": F.array(F.lit("PR1")), "p2": F.array(F.lit("DX2")), "p3": F.array(F.lit("PR3")), "p4": F.array(F.lit("DX4"))}
    rule = C.planned_columns(
        F.col("d"), F.col("p"), sets, F.col("d").isin("DX0", "DX2", "DX4"), lambda c: c.isin("PR0", "PR1", "PR3")
    )
    assert row.select(rule["planned_status"]).first()[0] == status


def test_code_map_refuses_two_categories(spark):
    mapping = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", "y"), ("B", "z")], "code string, cat string")
    with pytest.raises(ValueError):
        C.code_map(mapping, ["code"], "cat")
    assert C.code_map(mapping.where("code = 'A'"), ["code"], "cat").count() == 1


def test_visit_sequence(spark):
    row = spark.createDataFrame(
        [([4], [5, 6], [None], 3, [7], [8])],
        "dx array<int>, pr array<int>, day array<int>, stay int, pdx array<int>, ppr array<int>",
    )
    build = lambda limit: row.select(
        A.visit_sequence(*[F.col(c) for c in ("dx", "pr", "day", "stay", "pdx", "ppr")], 10, limit).alias("s")
    ).select(*[A.field(F.col("s"), f).alias(f) for f in ("id", "kind", "time", "visit")]).first()
    assert tuple(build(8)) == ([4, 15, 16, 7, 18], [0, 1, 1, 0, 1], [0] * 5, [0, 0, 0, 1, 1])
    # the prior bag keeps one place
    assert tuple(build(3))[0] == [4, 15, 7]


def test_empty_sequence_is_the_empty_token(spark):
    row = spark.createDataFrame([([], [3], [0], 1)], "dx array<int>, pr array<int>, day array<int>, stay int")
    s = A.single_visit_sequence(F.col("dx"), F.col("pr"), F.col("day"), F.col("stay"), 10, 8)
    assert row.select(A.field(s, "id")).first()[0] == [3]


def test_day_after_the_end_is_not_a_real_time(spark):
    row = spark.createDataFrame([([4, 5, 6, 3], [0, 3, -99, -99], 2)], "ids array<int>, days array<int>, stay int")
    counts = A.timing_counts(F.col("ids"), F.col("days"), F.col("stay"))
    r = row.select(*[c.alias(n) for n, c in counts.items()]).first()
    assert (r["day0_count"], r["after_end_count"], r["missing_count"]) == (1, 1, 1)


def test_masked_sample_picks_at_least_one_and_keeps_reserved(spark):
    rows = spark.createDataFrame([(k, [3, 10 + k]) for k in range(200)] + [(999, [3])], "k int, ids array<int>")
    out = {r["k"]: r["s"] for r in rows.select("k", A.masked_sample(F.col("k"), F.col("ids"), 1, 500).alias("s")).collect()}
    for k in range(200):
        assert out[k][0]["label"] is None and out[k][1]["label"] == 10 + k
    share = sum(out[k][1]["input"] == 1 for k in range(200)) / 200
    assert 0.7 < share < 0.9 and out[999][0]["label"] is None


def plain_masked(key, ids, seed, size, share=0.15):
    """The sample by its definition, from one md5 per draw."""
    head = f"{seed}:" if key is None else f"{seed}:{key}:"
    bits = lambda i, use, digits: int(hashlib.md5(f"{head}{i}:{use}".encode()).hexdigest()[:digits], 16)
    u = {i: bits(i, "pick", 8) / 2**32 for i, x in enumerate(ids) if x is not None and x > 3}
    picked = {i for i in u if u[i] < share} or ({min(u, key=lambda i: (u[i], i))} if u else set())
    how = {i: bits(i, "how", 8) / 2**32 for i in picked}
    other = lambda i: 4 + bits(i, "id", 12) % (size - 4)
    return [(x if i not in picked or how[i] >= 0.9 else 1 if how[i] < 0.8 else other(i), x if i in picked else None) for i, x in enumerate(ids)]


def test_masked_sample_of_null_empty_and_reserved_ids(spark):
    rows = [(k, [4 + (k * i) % 40 if i % 3 else 3 for i in range(k % 9)]) for k in range(120)]
    rows += [(500, None), (None, [9, 8, 7]), (None, [None, 5]), (501, []), (502, [1, 2, 3]), (503, [None])]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, k long, ids array<int>").repartition(3)
    for part in (df, df.where("n > 122")):
        got = {r["n"]: r["s"] and [tuple(e) for e in r["s"]] for r in part.select("n", A.masked_sample(F.col("k"), F.col("ids"), 7, 44).alias("s")).collect()}
        assert got == {n: ids and plain_masked(k, ids, 7, 44) for n, (k, ids) in enumerate(rows) if n in got}


def test_masked_sample_of_a_long_sequence_takes_a_draw_per_id(spark):
    ids = [4 + i % 90 for i in range(6000)]
    rows = spark.createDataFrame([(1, ids)], "k int, ids array<int>")
    began = time.perf_counter()
    got = rows.select(A.masked_sample(F.col("k"), F.col("ids"), 7, 94).alias("s")).first()["s"]
    assert [tuple(e) for e in got] == plain_masked(1, ids, 7, 94)
    # a draw per pair of positions would be 36 million md5 sums, several times over
    assert time.perf_counter() - began < 20


def test_frozen_one_hot_and_scaling(spark):
    development = spark.createDataFrame([(10.0, 1), (None, 2), (20.0, None)], "age double, payer int")
    later = spark.createDataFrame([(1000.0, 99), (None, None)], "age double, payer int")
    state, levels = features.fit_numeric(development, ["age"]), features.fit_levels(development, ["payer"])
    assert levels == {"payer": ("1", "2")}
    rows = later.select(features.static_vector(state, levels).alias("v")).collect()
    assert rows[0]["v"][0] > 100 and rows[0]["v"][2:] == [0, 0, 0, 1] and rows[1]["v"] == [0, 1, 0, 0, 1, 0]


def test_clip_year_slot_and_bands(spark):
    r = one(spark, V.clip(F.lit(0.0)), V.clip(F.lit(0.2)), V.clip(F.lit(1.0)), V.age_band(F.lit(44.5)), V.age_band_half_open(F.lit(44.5)))
    assert tuple(r) == (1e-7, 0.2, 1 - 1e-7, "45-64", "18-44")
    known = {2018: 0, 2021: 3}
    assert one(spark, V.year_slot(F.lit(2022), known, future=4))[0] == 4
    with pytest.raises(Exception, match="outside the contract"):
        one(spark, V.year_slot(F.lit(2022), known))
    with pytest.raises(Exception, match="missing year"):
        one(spark, V.year_slot(F.lit(None).cast("int"), known, future=4))
