import functools
import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import chat as C


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return bool(roles) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


def cheapest(roles):
    """Least cost over all labels, merges and insertions, by trying everything."""
    best = None
    for labels in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        cost = sum(C.RELABEL for a, b in zip(roles, labels) if C.STATES[C.role_number(a)] != b)
        for joins in itertools.product((False, True), repeat=max(0, len(labels) - 1)):
            if any(j and labels[i] != labels[i + 1] for i, j in enumerate(joins)):
                continue
            turns = [labels[0], *[b for b, j in zip(labels[1:], joins) if not j]]
            extra = fewest_inserts(tuple(turns))
            if extra is not None:
                total = cost + C.MERGE * sum(joins) + C.INSERT * extra
                best = total if best is None else min(best, total)
    return best


@functools.lru_cache(maxsize=None)
def fewest_inserts(turns):
    """Shortest legal conversation that holds the turns in their order."""
    for pairs in range(1, len(turns) + 3):
        for whole in (("user", "assistant") * pairs, ("system", *("user", "assistant") * pairs)):
            rest = iter(whole)
            if ("system" in whole) == ("system" in turns) and legal(list(whole)) and all(t in rest for t in turns):
                return len(whole) - len(turns)
    return None


def cost_of(roles, states):
    total = sum(C.STEPS[C.role_number(r)][s][t] for r, s, t in zip(roles, states, states[1:]))
    return total + C.CLOSING[states[-1]][0]


@pytest.mark.parametrize("length", [1, 2, 3, 4])
def test_repairs_are_the_cheapest(length):
    for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=length):
        states = C.trace([C.role_number(r) for r in roles], C.BEGIN, None)
        assert cost_of(roles, states) == cheapest(roles), roles


def chat_of(rows):
    rows = sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0, r.source_role is not None, r.source_role or "", r.rendered))
    return "".join(r.rendered for r in rows)


def parse(text):
    turns = text.split(C.CLOSE)
    assert turns[-1] == ""
    return [t.split("|>\n", 1)[0].removeprefix("<|") for t in turns[:-1]]


def conversations(n, seed=8):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "Human "]), f"m{c}.{t}" + " <|end|>" * (t % 5 == 0))
        for c in range(n)
        for t in range(rng.randrange(1, 14))
    ]


@pytest.mark.parametrize("block", [1024, 3, 1])
def test_every_chat_is_legal_and_whole(spark, block):
    rows = conversations(60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = C.repair(df, block=block).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for c, mine in by.items():
        text = chat_of(mine)
        assert legal(parse(text))
        for _, t, _, body in (r for r in rows if r[0] == c):
            assert body.replace("<|", "<\\|") in text
        roles = [r[2] for r in rows if r[0] == c]
        states = C.trace([C.role_number(r) for r in roles], C.BEGIN, None)
        assert [r.role for r in sorted(mine, key=lambda r: r.turn)] == [C.STATES[s] for s in states[1:]]
        last = max(mine, key=lambda r: r.turn)
        closing = len(C.CLOSING[states[-1]][1])
        assert last.turn_out + 1 + closing == len(parse(text))


def test_blocks_do_not_matter(spark):
    rows = [(1, t % 400, r, x) for _, t, r, x in conversations(200, 9)]  # one conversation, many ties
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    want = sorted(map(str, C.repair(df, block=10_000).collect()))
    for block in (1, 5, 64):
        assert sorted(map(str, C.repair(df, block=block).collect())) == want


def test_defined_cases(spark):
    df = spark.createDataFrame(
        [(None, 0, "user", "a", "k"), (None, 1, "assistant", None, "k"), (2, None, None, "", "k"), (3, 0, "user", "same", "k"), (3, 0, "user", "same", "k"),
         (4, 0, "user", "long " * 50_000, "k")],
        "conv_id long, turn long, role string, text string, rendered string",
    ).withColumn("key", F.lit(1))
    out = C.repair(df).collect()
    assert len(out) == 6
    assert {r.action for r in out if r.conv_id == 3} == {"keep", "merge"}
    assert [r.role for r in out if r.conv_id is None] == ["user", "assistant"]
    assert C.repair(df.limit(0)).count() == 0
