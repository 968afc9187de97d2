import random

import pytest

from strandline.llm import contamination as C


def plain_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(words, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min((d, j) for j, d in enumerate(row))


def test_bit_parallel_distance_is_the_plain_one():
    rng = random.Random(4)
    for _ in range(600):
        item = rng.choices("abcd", k=rng.randrange(1, 90))
        words = rng.choices("abcd", k=rng.randrange(0, 120))
        assert C.distance(item, words) == plain_distance(item, words)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"more{rng.randrange(99)}")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.mark.parametrize("block_items", [5000, 4])
def test_no_item_within_its_budget_is_missed(spark, block_items, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40)))) for i in range(12)]
    monkeypatch.setattr(C, "TEXT_BYTES", 1_000)
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        item = items[rng.randrange(12)][1].split()
        at = rng.randrange(len(words) + 1)
        words[at:at] = edited(item, rng.randrange(0, 9), rng)
        docs.append((d, " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", ",", "\n"]) for w in words)))
    want = {}
    for d, text in docs:
        for i, body in items:
            item = C.words_of(body)
            edits, _ = plain_distance(item, C.words_of(text))
            if edits <= int(C.RATE * len(item)):
                want[d, i] = edits
    df, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in C.matches(df, table, block_items=block_items).collect()}
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in C.drop_contaminated(df, table, block_items=block_items).collect()}
    long = {i for i, body in items if len(C.words_of(body)) >= C.EVIDENCE_WORDS}
    assert kept == {d for d, _ in docs} - {d for d, i in want if i in long}
    every = C.drop_contaminated(df, table, min_words=1, block_items=block_items).collect()
    assert {r.doc_id for r in every} == {d for d, _ in docs} - {d for d, _ in want}


def test_defined_cases(spark):
    item = "one two three four five six seven"
    df = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (3, item, 5), (3, item, 5), (None, f"x {item}", 5), (4, "y " * 50_000 + item, 5)], "doc_id long, text string, item_id int"
    )
    table = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "x q"), (5, "y one"), (None, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in C.matches(df, table).collect()), key=str)
    assert got == sorted([(3, 1), (3, 1), (None, 1), (4, 1), (4, 5), (3, None), (3, None), (None, None), (4, None)], key=str)
    kept = C.drop_contaminated(df, table)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2}
    assert C.matches(df.limit(0), table).count() == 0 and C.matches(df, table.limit(0)).count() == 0
    assert C.drop_contaminated(df, table.limit(0)).count() == 6
