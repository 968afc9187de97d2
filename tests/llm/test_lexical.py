import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import lexical as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in own
                if t in bag
            )
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, **options):
    got = L.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k, **options)
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda size: " ".join(rng.choice(words[: rng.choice((5, 20, 60))]) for _ in range(size))
    docs = [(i, text(rng.choice((0, 1, 3, 30, 200)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)]  # ties
    return docs, [(i, text(rng.choice((1, 4, 25)))) for i in range(12)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("k", [1, 10])
def test_against_every_document(spark, seed, k, monkeypatch):
    monkeypatch.setattr(L, "BUCKET", 16)
    docs, items = corpus(seed, 250)
    assert found(spark, docs, items, k) == plain(docs, items, k)


def test_blocks_of_items(spark):
    docs, items = corpus(9, 120)
    assert found(spark, docs, items, block_terms=20) == plain(docs, items, 10)


def test_defined_cases(spark):
    long = "long " * 300_000 + "ending"
    docs = [(1, None), (2, ""), (3, "..."), (4, "Éa été ÉA a_b `x` 42"), (4, "a b"), (None, "a été"), (5, "Z" * 300), (6, long), (7, "x\x00y a"), (8, "東京")]
    items = [(1, "été A"), (1, "42"), (2, None), (3, ""), (None, "x 東京"), (4, "z" * 300 + " Ending"), (5, "nowhere"), (6, "ÉA")]
    assert found(spark, docs, items) == plain(docs, items, 10)


@pytest.mark.parametrize("docs,items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, "")], [(1, "a")])])
def test_nothing_to_rank(spark, docs, items):
    assert found(spark, docs, items) == []


def test_clashing_columns(spark):
    docs, items = corpus(4, 60)
    more = ("term", "terms", "n", "norm", "item_id", "rank", "score", "block", "body")
    left = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit("x") for c in more})
    right = spark.createDataFrame(items, ITEMS).withColumns({c: F.lit("x") for c in ("doc_id", "term", "block", "score")})
    got = sorted((tuple(r) for r in L.ranked(left, right).collect()), key=str)
    assert got == plain(docs, items, 10)


def test_bounds_never_lose_a_document_and_do_prune():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 30, 400)
    own = [np.sort(rng.choice(80, s, replace=False)).astype(np.int32) for s in sizes]
    values = [rng.integers(1, 900_000, s).astype(np.int32) for s in sizes]
    norms = [math.sqrt(sum(float(x) ** 2 for x in v)) for v in values]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400)), pa.array(norms), pa.array(own, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))],
        names=["doc_id", "norm", "terms", "impacts"],
    )
    bucket = L.Bucket(batch, 80)
    kept = 0
    for _ in range(20):
        item = rng.choice(80, 12, replace=False)
        weights = np.sort(rng.integers(1, 8_000, 12))[::-1]
        dense = np.zeros(80, np.int64)
        dense[item] = weights
        exact = np.array([(dense[t] * v.astype(np.int64)).sum() for t, v in zip(own, values)])
        floor = np.sort(exact)[-10]
        alive = bucket.survivors(item, weights, float(floor))
        assert set(np.flatnonzero(exact >= floor)) <= set(alive)
        assert (bucket.scores(alive, dense) == exact[alive]).all()
        kept += len(alive)
    assert kept < 20 * 400 * 0.1
