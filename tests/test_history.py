import random

from pyspark.sql import functions as F

from strandline.layout import Encounter
from strandline.operators.history import history_cells, id_spans, with_history

COLUMNS = (
    "enc_id long, entity_id long, start_day int, stay int, month int, emergency int, elective int, severity int, risk int, "
    "a boolean, b boolean, dx array<int>, pr array<int>"
)
LAYOUT = Encounter(entity=("entity_id",))


def history(spark, rows, index):
    adm = spark.createDataFrame(rows, COLUMNS)
    cells = history_cells(adm, "emergency", "elective", ["a", "b"], ["severity", "risk"], LAYOUT)
    out = with_history(adm.where(F.col("enc_id") == index), cells, id_spans(adm, ["dx", "pr"], LAYOUT), ["a", "b"], ["severity", "risk"], ["dx", "pr"], LAYOUT)
    return out.first().asDict()


def plain_history(rows, index):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    typed = [dict(zip(names, r)) for r in rows]
    me = next(r for r in typed if r["enc_id"] == index)
    prior = []
    for r in typed:
        stay = max(r["stay"] or 0, 0)
        end = r["start_day"] + stay
        if r["entity_id"] == me["entity_id"] and end + (0 if stay else 0.5) <= me["start_day"]:
            prior.append({**r, "stay": stay, "end": end})
    within = lambda n: [r for r in prior if me["start_day"] - r["end"] <= n]
    half = within(180)
    bag = lambda c: sorted({x for r in half for x in r[c] if x > 3})
    return {
        "prior_count_ytd": len(prior), "prior_count_30d": len(within(30)), "prior_count_90d": len(within(90)), "prior_count_180d": len(half),
        "prior_emergency_180d": sum((r["emergency"] or 0) > 0 for r in half), "prior_nonelective_180d": sum(r["elective"] != 1 for r in half),
        "prior_stay_sum_180d": sum(r["stay"] for r in half), "prior_a_180d": sum(bool(r["a"]) for r in half),
        "prior_max_severity_180d": max([r["severity"] or 0 for r in half], default=0), "prior_dx_180d": bag("dx"), "prior_pr_180d": bag("pr"),
        "days_since_prior": me["start_day"] - max(r["end"] for r in prior) if prior else -1,
    }


def test_history_is_the_row_by_row_count(spark):
    rng = random.Random(43)
    codes = lambda: [rng.randrange(0, 30) for _ in range(rng.randrange(4))]
    rows = [
        (key, rng.randrange(4), rng.randrange(1, 300), rng.choice([0, 0, 1, 4, 20]), rng.randrange(1, 13), rng.choice([None, 0, 1, 2]),
         rng.choice([None, 0, 1]), rng.choice([None, 1, 4]), rng.choice([None, 2]), rng.random() < 0.3, None, codes(), codes())
        for key in range(70)
    ]
    adm = spark.createDataFrame(rows, COLUMNS)
    cells = history_cells(adm, "emergency", "elective", ["a", "b"], ["severity", "risk"], LAYOUT)
    out = with_history(adm, cells, id_spans(adm, ["dx", "pr"], LAYOUT), ["a", "b"], ["severity", "risk"], ["dx", "pr"], LAYOUT).collect()
    assert len(out) == 70
    for r in out:
        want = plain_history(rows, r["enc_id"])
        assert {k: r[k] for k in want} == want, r["enc_id"]
        assert (r["seen_30d"], r["seen_90d"], r["seen_180d"]) == (r["month"] >= 2, r["month"] >= 4, r["month"] >= 7)


def test_no_history_gives_zeroes(spark):
    r = history(spark, [(10, 99, 200, 3, 7, 1, 0, 2, 1, True, False, [4], [10])], 10)
    assert (r["prior_count_ytd"], r["prior_count_30d"], r["days_since_prior"]) == (0, 0, -1)
    assert r["prior_dx_180d"] == [] and r["prior_max_severity_180d"] == 0


def test_zero_day_stay_on_the_index_day_is_not_prior(spark):
    rows = [
        (1, 1, 50, 0, 5, 0, None, None, None, False, False, [], []),
        (2, 1, 48, 2, 5, 0, None, None, None, False, False, [], []),
        (3, 1, 50, 3, 5, 0, 0, 1, 1, False, False, [], []),
    ]
    r = history(spark, rows, 3)
    # the stay that ended on the index day counts, the one that began on it does not
    assert (r["prior_count_ytd"], r["days_since_prior"]) == (1, 0)
    # a missing elective mark counts as not elective; missing severities give 0
    assert (r["prior_nonelective_180d"], r["prior_max_severity_180d"]) == (1, 0)


def test_spans_of_one_id_do_not_overlap(spark):
    rng = random.Random(3)
    rows = [(k, k % 3, rng.randrange(1, 360), 1, 1, 0, 0, 0, 0, False, None, [4, 5, 5, rng.randrange(4, 9)], None) for k in range(90)]
    spans = id_spans(spark.createDataFrame(rows, COLUMNS), ["dx", "pr"], LAYOUT).collect()
    by = {}
    for s in spans:
        by.setdefault((s.entity_id, s.column, s.id), []).append((s["first"], s["last"]))
    for held in by.values():
        held.sort()
        assert all(a[1] < b[0] for a, b in zip(held, held[1:])) and all(b - a <= 360 for a, b in held)
