import datetime as dt
import random
import time

from pyspark.sql import functions as F

from strandline.operators import chains as C
from strandline.operators.history import with_stay_history

SCHEMA = "subject_id string, stay_id long, begin_ts timestamp, end_ts timestamp, from_place string, to_place string"
BASE = dt.datetime(2020, 1, 1)


def brute(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for mine in by.values():
        mine.sort(key=lambda r: (r[2], r[3], r[1]))
        chain = []
        for r in mine:
            if chain:
                prev = max(chain, key=lambda x: (x[3], x[1]))
                moved = "ACUTE HOSPITAL" in r[4] or "ACUTE HOSPITAL" in prev[5]
                if r[2] <= prev[3] or (r[2] - prev[3] <= dt.timedelta(hours=24) and moved):
                    chain.append(r)
                    out[r[1]] = chain[0][1]
                    continue
            chain = [r]
            out[r[1]] = r[1]
    return out


def test_chains_equal_the_row_by_row_rule(spark):
    rng = random.Random(2)
    place = lambda: rng.choice(["HOME", "HOME", "ACUTE HOSPITAL"])
    rows = []
    for key in range(400):
        subject = "hot" if key % 3 == 0 else f"s{rng.randrange(20)}"
        begin = BASE + dt.timedelta(minutes=rng.randrange(400 * 24 * 60 if subject == "hot" else 60 * 24 * 60))
        rows.append((subject, key, begin, begin + dt.timedelta(minutes=rng.randrange(3000)), place(), place()))
    linked = C.link_chains(spark.createDataFrame(rows, SCHEMA))
    assert {r["stay_id"]: r["chain_id"] for r in linked.collect()} == brute(rows)


def test_reasons_are_exclusive_and_add_up(spark):
    rows = [
        ("1", "1", "2020-01-01", "2020-01-02"),
        ("1", "2", "2020-01-05", "2020-01-06 10:00:00"),
        ("", "x", "2020-01-01", "2020-01-02"),
        ("99", "990", "", "2020-01-02"),
        ("98", "980", "2020-01-03", "2020-01-02"),
    ]
    raw = spark.createDataFrame(rows, "subject_id string, stay_id string, begin_ts string, end_ts string")
    out = {r["reason"]: r["n"] for r in C.reason_counts(C.parse_stays(raw)).collect()}
    assert out == {"valid": 2, "missing_ids": 1, "invalid_or_missing_timestamps": 1, "end_before_begin": 1}


def test_label_bounds(spark):
    day = lambda n: BASE + dt.timedelta(days=n)
    index = spark.createDataFrame([("a", 1, day(0), day(1)), ("b", 2, day(0), day(1)), ("c", 3, day(0), day(1))],
                                  "subject_id string, chain_id long, begin_ts timestamp, end_ts timestamp")
    chains = spark.createDataFrame(
        [
            ("a", 11, day(5), "stable_planned", "x"), ("a", 12, day(9), "stable_unplanned", "ap"), ("a", 13, day(10), "algorithm_unknown", None),
            ("b", 21, day(3), "algorithm_unknown", None), ("b", 22, day(4), "stable_unplanned", "ap"),
            ("c", 31, day(40), "stable_unplanned", "ap"),
        ],
        "subject_id string, chain_id long, begin_ts timestamp, state string, cause string",
    ).withColumn("end_ts", F.col("begin_ts"))
    out = {r["subject_id"]: r for r in C.with_chain_label(index, chains, "state", "cause").collect()}
    assert (out["a"]["any_follow_up"], out["a"]["leaf"], out["a"]["label_status"]) == (1, "ap", "qualified")
    assert (out["b"]["any_follow_up"], out["b"]["if_unknown_planned"], out["b"]["if_unknown_unplanned"]) == (None, 0, 1)
    assert (out["c"]["any_follow_up"], out["c"]["leaf"]) == (0, "none")


def test_exact_tie_is_settled_by_key(spark):
    day = lambda n: BASE + dt.timedelta(days=n)
    index = spark.createDataFrame([("a", 1, day(0), day(1))], "subject_id string, chain_id long, begin_ts timestamp, end_ts timestamp")

    def status(unknown_key):
        chains = spark.createDataFrame(
            [("a", unknown_key, day(5), "algorithm_unknown", None), ("a", 50, day(5), "stable_unplanned", "ap")],
            "subject_id string, chain_id long, begin_ts timestamp, state string, cause string",
        ).withColumn("end_ts", F.col("begin_ts"))
        return C.with_chain_label(index, chains, "state", "cause").first()["label_status"]

    assert status(40) == "algorithm_unknown" and status(60) == "qualified"


def busy_chains(spark, n):
    """One entity with a chain a minute."""
    minute = lambda c: F.timestamp_seconds(F.lit(1_600_000_000) + c * 60)
    return spark.range(n).select(
        F.lit("one").alias("subject_id"),
        F.col("id").alias("chain_id"),
        minute(F.col("id")).alias("begin_ts"),
        F.timestamp_seconds(F.lit(1_600_000_030) + F.col("id") * 60).alias("end_ts"),
        F.when(F.pmod("id", F.lit(7)) == 0, "algorithm_unknown").when(F.pmod("id", F.lit(5)) == 0, "stable_planned").otherwise("stable_unplanned").alias("state"),
        F.lit("ap").alias("cause"),
    )


def test_a_busy_entity_costs_no_more_than_its_rows(spark):
    def seconds(n):
        chains = busy_chains(spark, n)
        began = time.perf_counter()
        for out in (with_stay_history(chains, chains), C.with_chain_label(chains, chains, "state", "cause")):
            out.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1_000)  # warm-up
    few, many = seconds(5_000), seconds(50_000)
    assert many < 10 * few + 5
    out = {r["chain_id"]: r for r in with_stay_history(busy_chains(spark, 5_000), busy_chains(spark, 5_000)).where("chain_id < 3 OR chain_id = 4999").collect()}
    assert [out[i]["prior_count_30d"] for i in (0, 1, 2, 4999)] == [0, 1, 2, 4999]
    assert out[0]["days_since_prior"] is None and out[2]["days_since_prior"] == 30 / 86400


def test_labels_are_those_of_the_row_by_row_rule(spark):
    rng = random.Random(61)
    base = dt.datetime(2020, 1, 1)
    at = lambda h: base + dt.timedelta(hours=h)
    states = ["stable_unplanned", "algorithm_unknown", "stable_planned"]
    rows = []
    for k in range(160):
        begin = rng.randrange(0, 24 * 200)
        rows.append((f"s{k % 5}", k, at(begin), at(begin + rng.randrange(0, 40)), rng.choice(states), rng.choice(["ap", None])))
    df = spark.createDataFrame(rows, "subject_id string, chain_id long, begin_ts timestamp, end_ts timestamp, state string, cause string")
    got = {r["chain_id"]: (r["label_status"], r["any_follow_up"], r["leaf"]) for r in C.with_chain_label(df, df, "state", "cause").collect()}
    for subject, key, _, end, _, _ in rows:
        month, none = dt.timedelta(days=30), dt.timedelta(0)
        near = [(b, k, state, cause) for s, k, b, _, state, cause in rows if s == subject and none < b - end <= month]
        near.sort(key=lambda r: r[:2])
        first = lambda state: next(((b, k, c) for b, k, st, c in near if st == state), None)
        u, x = first("stable_unplanned"), first("algorithm_unknown")
        if x and (not u or x[:2] < u[:2]):
            want = ("algorithm_unknown", None, None)
        elif not u:
            want = ("none", 0, "none")
        else:
            want = ("qualified" if u[2] else "cause_unknown", 1, u[2])
        assert got[key] == want, key
