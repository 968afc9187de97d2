import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import simhash as S


def plain_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, near):
    """Smallest id reachable over linked values, by comparing all."""
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    values = list(prints)
    for i, a in enumerate(values):
        for b in values[:i]:
            if near(a, b):
                parent[find(a)] = find(b)
    return find


def texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            body = out[rng.randrange(len(out))].split()
            for _ in range(rng.randrange(4)):
                body[rng.randrange(len(body))] = rng.choice(words)
            out.append(" ".join(body))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randrange(30, 160))))
    return out


@pytest.mark.parametrize("text", ["", None, " \n ", "One", "one TWO", "a b c", "É é\x0bX y z w", "x " * 500])
def test_fingerprint_is_the_plain_one(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert int.from_bytes(S.fingerprints(df).first().fp, "big") == plain_print(text)


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    body = " ".join(texts(20)).encode()
    whole = S.shingle_hashes(body, 3)
    monkeypatch.setattr(S, "word_pieces", lambda data: ([w] for w in data.split()))
    assert np.array_equal(S.shingle_hashes(body, 3), whole)


@pytest.mark.parametrize("block", [4096, 6])
def test_classes_lose_no_link(spark, block):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):  # chains of values a few bits apart, some dense
        v = rng.choice(values)
        for _ in range(rng.randrange(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values += [0, 0, 7, 1 << 63]
    df = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "doc_id long, fp binary")
    find = plain_classes(set(values), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(find(v), i)
    got = {r.doc_id: r.component_id for r in S.classes(df, block=block).collect()}
    assert got == {i: least[find(v)] for i, v in enumerate(values)}


def test_large_dense_group_becomes_one_class(spark):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    df = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "doc_id long, fp binary")
    assert {r.component_id for r in S.classes(df, block=100).collect()} == {0}


@pytest.mark.parametrize("block", [2048, 4])
def test_near_copies_are_those_of_the_plain_comparison(spark, block):
    rows = texts(150) + ["", "  ", None, "short one", "short one"]

    def grams(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    def near(a, b):
        return bool(a and b) and len(a & b) >= 0.8 * len(a | b)

    sets = [grams(t) for t in rows]
    find = plain_classes(dict.fromkeys(sets), near)
    least = {}
    for i, s in enumerate(sets):
        least.setdefault(find(s), i)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in S.near_copies(df, exact_block=block).collect()}
    wrong = [i for i, s in enumerate(sets) if got[i] != least[find(s)]]
    assert wrong == []
    assert all(got[i] >= least[find(sets[i])] for i in got)  # what is joined is truly near


def near_group(m):
    """``m`` fingerprints of 4,096 bits, each a few scattered bits off one another, as near copies have."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 512, dtype=np.uint8)
    out = []
    for i in range(m):
        bits = np.zeros(4096, np.uint8)
        bits[rng.choice(4096, 250, replace=False)] = 1
        out.append((i, bytes(base ^ np.packbits(bits))))
    return out


def test_edges_of_a_group_of_near_copies_grow_with_its_members(spark, monkeypatch):
    made = {}
    seen = S.connected
    for m in (150, 600):

        def count(edges, m=m):
            made[m] = edges.count()
            return seen(edges)

        monkeypatch.setattr(S, "connected", count)
        prints = spark.createDataFrame(near_group(m), "doc_id long, fp binary")
        found = S.classes(prints, S.WIDE_WORDS, S.WIDE_BITS, 0, kept=S.WIDE_KEPT).collect()
        assert {r.component_id for r in found} == {0}
    assert all(edges < 1.5 * m for m, edges in made.items())


@pytest.mark.parametrize("limit", [4, 50, 10_000])
def test_stars_connect_what_the_edges_connect(spark, limit):
    rng = np.random.default_rng(limit)
    a, b = rng.integers(0, 400, 500), rng.integers(0, 400, 500)
    gathered, out = S.Gathered(limit), []
    for i in range(0, 500, 20):
        out += list(gathered.add(a[i : i + 20], b[i : i + 20]))
    out += list(gathered.rest())
    edges = [(int(x), int(y)) for r, m in out for x, y in zip(r, m)]

    def groups(pairs):
        label = {i: i for i in range(400)}
        for _ in range(400):
            before = dict(label)
            for x, y in pairs:
                label[x] = label[y] = min(label[x], label[y])
            if before == label:
                return label

    assert groups(edges) == groups(list(zip(a.tolist(), b.tolist())))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    assert groups([(r.a, r.b) for r in S.as_stars(df).collect()]) == groups(edges)


def test_defined_cases(spark):
    df = spark.createDataFrame(
        [(1, "a b c d", 9), (1, "a b c d", 9), (None, "a b c d", 1), (None, "z z y", 1), (2, None, 0), (3, "", 0)],
        "doc_id long, text string, component_id int",
    ).withColumn("fp", F.lit("x"))
    got = sorted(S.classes(S.fingerprints(df)).select("doc_id", "component_id").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 2)], key=str)
    kept = S.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["1", "1", "2", "None", "None"]
    empty = df.limit(0)
    assert S.classes(S.fingerprints(empty)).count() == 0 and S.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("edit", ["appended", "truncated", "replaced"])
def test_copies_with_one_passage_changed_are_found(spark, edit):
    """Pairs at a similarity of 0.80 to 0.81, none of which may be missed."""
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    rows, pairs = [], 120
    for i in range(pairs):
        words = prose(rng.randrange(300, 600))
        n = len(words)
        if edit == "appended":
            other = words + prose(int(n * 0.24))
        elif edit == "truncated":
            other = words[: n - int(n * 0.195)]
        else:
            size, at = int((0.2 * n - 8) / 1.8), rng.randrange(50, n // 2)
            other = words[:at] + prose(size) + words[at + size :]
        a, b = (set(zip(*[t[k:] for k in range(5)])) for t in (words, other))
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(pairs) if got[2 * i + 1] != 2 * i] == []
