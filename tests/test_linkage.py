import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.layout import Encounter
from strandline.operators import linkage as L
from strandline.operators import skew

COLUMNS = (
    "year int, enc_id int, entity_id string, start_day string, stay string, month int, age string, died int, "
    "disposition string, principal_1 boolean, planned_status int, cause_code int"
)


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def text_rows(n=400, seed=41):
    """Numbers as text, some of them missing or unreadable, several stays on one day."""
    rng = random.Random(seed)
    day = lambda: rng.choice(["", "n/a", None]) if rng.random() < 0.08 else str(rng.randrange(1, 330))
    stay = lambda: rng.choice([None, "?", "-2"]) if rng.random() < 0.08 else str(rng.randrange(0, 8))
    return [
        (2031, key, f"e{rng.randrange(45)}", day(), stay(), rng.randrange(1, 13), str(rng.randrange(10, 90)), int(rng.random() < 0.05),
         str(rng.randrange(0, 22)), rng.random() < 0.5, rng.choice([-1, 0, 0, 0, 1]), rng.randrange(1, 5))
        for key in range(n)
    ]


def plain_evaluation(rows):
    """The evaluation rule restated row by row: days are numbers, and no unknown encounter means no doubt."""
    whole = lambda t: None if number(t) is None else math.floor(number(t))
    typed = [dict(zip((c.split()[0] for c in COLUMNS.split(", ")), r)) for r in rows]
    for r in typed:
        r["start_day"], r["stay"] = whole(r["start_day"]), whole(r["stay"])
    out = {}
    for r in typed:
        if not r["principal_1"] or r["start_day"] is None or r["stay"] is None:
            continue
        end = r["start_day"] + max(r["stay"], 0)
        mine = [o for o in typed if o["entity_id"] == r["entity_id"] and o["start_day"] is not None]
        later = sorted((o["start_day"], o["enc_id"]) for o in mine if (o["start_day"], o["enc_id"]) > (r["start_day"], r["enc_id"]))
        gap = later[0][0] - end if later else None
        window = [o for o in mine if 1 <= o["start_day"] - end <= 30]
        known = sorted((o["start_day"], o["enc_id"], o["cause_code"]) for o in window if o["planned_status"] == 0)
        unknown = min((o["start_day"] for o in window if o["planned_status"] == -1), default=None)
        doubt = unknown is not None and (not known or unknown <= known[0][0])
        base = number(r["age"]) >= 18 and r["died"] == 0 and number(r["disposition"]) not in (2, 20) and r["month"] <= 11 and (gap is None or gap >= 1)
        out[r["enc_id"]] = (gap, doubt, base and not doubt, bool(known), known[0][2] if known else 0)
    return out


@pytest.mark.parametrize("seed", [41, 42])
def test_text_typed_rows_follow_the_evaluation_rule(spark, seed):
    rows = text_rows(seed=seed)
    adm = L.numeric_days(spark.createDataFrame(rows, COLUMNS))
    rule = L.evaluation_rule("principal_1", "age", "died", "disposition")
    usable = F.col("principal_1") & F.col("start_day").isNotNull() & F.col("stay").isNotNull()
    out = L.build_episodes(adm, usable, rule, clip=True).collect()
    got = {r["enc_id"]: (r["next_gap"], r["uncertain"], r["eligible"], r["any_follow_up"], r["leaf"]) for r in out}
    want = plain_evaluation(rows)
    assert got == want
    assert any(w[1] for w in want.values()) and any(w[2] and not w[3] for w in want.values())
    # ordered as text, day 100 would come before day 20
    assert sorted(["20", "100"]) == ["100", "20"] and adm.where("start_day >= 100").count() > 0


def brute(rows):
    """Row-by-row restatement over (key, entity, day, stay, status, cause)."""
    out = {}
    for key, entity, day, stay, _, _ in rows:
        mine = sorted((r for r in rows if r[1] == entity), key=lambda r: (r[2], r[0]))
        later = [r for r in mine if (r[2], r[0]) > (day, key)]
        window = [r for r in mine if 1 <= r[2] - day - stay <= 30]
        unplanned = sorted((r[2], r[0], r[5]) for r in window if r[4] == 0)
        unknown = [r[2] for r in window if r[4] == -1]
        out[key] = (
            later[0][2] - day - stay if later else None,
            unplanned[0][1] if unplanned else None,
            unplanned[0][2] if unplanned else None,
            min(unknown) if unknown else None,
            sum(r[4] == 1 for r in window),
            len(unknown),
        )
    return out


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_linkage_with_a_hot_entity(spark, monkeypatch, hot_rows):
    """One entity holds a third of all rows; small limits force the spread path."""
    monkeypatch.setattr(skew.crowded, "__defaults__", (hot_rows,))
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", hot_rows, None))
    rng = random.Random(5)
    rows = []
    for key in range(600):
        entity = 0 if key % 3 == 0 else rng.randrange(1, 60)
        rows.append((key, entity, rng.randrange(1, 200), rng.randrange(0, 9), rng.choice([-1, 0, 0, 1]), rng.randrange(1, 5)))
    layout = Encounter(entity=("entity_id",))
    adm = spark.createDataFrame(rows, "enc_id long, entity_id long, start_day int, stay int, planned_status int, cause_code int")
    cells = L.day_cells(adm, layout)
    assert cells.count() < adm.count()
    out = L.with_next_gap(L.with_follow_up(adm, cells, layout), cells, layout).collect()
    got = {
        r["enc_id"]: (
            r["next_gap"], r["follow_up_key"], r["unplanned"]["cause"] if r["unplanned"] else None,
            r["first_unknown_day"], r["planned_follow_ups"], r["unknown_follow_ups"],
        )
        for r in out
    }
    assert len(out) == 600 and got == brute(rows)


def test_range_summary_buckets_agree_with_plain_windows(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(k, a, rng.randrange(5)) for k in range(3) for a in rng.sample(range(500), 80)], "k int, axis long, v int")
    queries = spark.createDataFrame([(k, a) for k in range(4) for a in range(0, 520, 7)], "k int, axis long")
    out = L.range_summary(
        cells, queries, ["k"], "axis", {"near": (-3, 5), "back": (-40, -1)},
        {"near": ("near", F.sum("v")), "back": ("back", F.max("v"))},
    ).collect()
    data = [tuple(r) for r in cells.collect()]
    assert len(out) == queries.count()
    for r in out:
        near = [v for k, a, v in data if k == r["k"] and r["axis"] - 3 <= a <= r["axis"] + 5]
        back = [v for k, a, v in data if k == r["k"] and r["axis"] - 40 <= a <= r["axis"] - 1]
        assert r["near"] == (sum(near) if near else None)
        assert r["back"] == (max(back) if back else None)
