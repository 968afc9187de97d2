import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing as M


def plain_rake(cells, targets, sweeps=200):
    w = {c: float(t) for c, t in cells.items() if t}
    total = sum(w.values())
    for _ in range(sweeps):
        for d, target in enumerate(targets):
            present = {c[d] for c in w}
            whole = sum(s for k, s in target.items() if k in present)
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * target.get(c[d], 0) / whole * total / sums[c[d]] if sums[c[d]] else 0.0 for c, x in w.items()}
    return {c: w[c] / cells[c] for c in w}


CELLS = {("a", "en", "t"): 900, ("a", "de", "t"): 50, ("b", "en", "u"): 300, ("b", "de", "u"): 80, ("b", "en", "t"): 40, ("c", "de", "t"): 10, ("c", "en", "u"): 0}
TARGETS = [{"a": 0.4, "b": 0.4, "c": 0.1, "absent": 0.1}, {"en": 0.6, "de": 0.4}, {"t": 0.7, "u": 0.3}]


def run(spark, cells, targets, **kw):
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "source string, lang string, topic string, tokens long")
    frames = {n: spark.createDataFrame(list(t.items()), "level string, share double") for n, t in zip(M.DIMENSIONS, targets)}
    return {(r.source, r.lang, r.topic): r for r in M.rake(df, frames, **kw).collect()}


def test_raking_is_the_plain_iteration(spark):
    got, want = run(spark, CELLS, TARGETS), plain_rake(CELLS, TARGETS)
    for c, w in want.items():
        assert got[c].weight == pytest.approx(w, rel=1e-4)
    assert got["c", "en", "u"].weight == 1.0 and all(r.converged for r in got.values())


CONTRARY = [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}, {"t": 1.0}]


def test_targets_that_contradict_each_other_are_told(spark):
    got = run(spark, {("a", "x", "t"): 50, ("b", "y", "t"): 50}, CONTRARY, sweeps=4)
    assert not any(r.converged for r in got.values())
    rows = [(i, "word " * 5, s, g) for i, (s, g) in enumerate([("a", "x"), ("b", "y")] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {
        n: spark.createDataFrame(list(t.items()), "level string, share double") for n, t in zip(M.DIMENSIONS, CONTRARY)
    }
    with pytest.raises(ValueError, match="contradict"):
        M.sample(docs, targets=targets, topic=F.lit("t"), strict=True, sweeps=4)
    assert M.sample(docs, targets=targets, topic=F.lit("t"), sweeps=4).count() <= 20


def test_marginals_reach_their_targets(spark):
    got = run(spark, CELLS, TARGETS)
    total = sum(CELLS.values())
    for d, target in enumerate(TARGETS):
        for level, share in target.items():
            sums = sum(CELLS[c] * r.weight for c, r in got.items() if c[d] == level)
            if level in {c[d] for c in CELLS}:
                whole = sum(s for k, s in target.items() if k in {c[d] for c in CELLS})
                assert sums / total == pytest.approx(share / whole, rel=1e-5)


def test_level_without_target_gets_nothing(spark):
    got = run(spark, CELLS, [{"a": 0.5, "b": 0.5}, TARGETS[1], TARGETS[2]])
    assert got["c", "de", "t"].weight == 0


def test_draws_follow_the_probabilities(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), M.draw(F.col("id")).alias("u"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.count_if(F.col("u") < 0.3)).first()
    assert 0 <= r[0] and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3] - 6000) < 300


def test_token_count_is_the_plain_count(spark):
    texts = ["", None, " a  b\tc d\n", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(M.token_count(F.col("text")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 3, 1]


def test_sample_defined_cases(spark):
    df = spark.createDataFrame(
        [(i, f"word {i} and more", None if i % 3 else "s", "en", 5, i) for i in range(60)] + [(None, None, "s", None, 0, 0), (7, "word 7 and more", None, "en", 5, 7)],
        "doc_id long, text string, source string, lang string, mix_weight long, _mix_source long",
    )
    out = M.sample(df)
    assert out.columns == ["doc_id", "text", "source", "lang", "_mix_source", "mix_weight"]
    rows = out.collect()
    assert 0 < len(rows) <= 62 and sum(r.doc_id == 7 for r in rows) in (0, 2)
    assert M.sample(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.0])
def test_expected_tokens_are_the_budget(spark, share):
    weighed = [(t, 0.2 + 7 * i * i) for i, t in enumerate(CELLS.values())]
    rows = M.to_budget(spark.createDataFrame(weighed, "tokens long, weight double"), share).collect()
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(share * sum(CELLS.values()), rel=1e-9)
    part = [r.probability / r.weight for r in rows if r.probability < 1]
    assert all(0 <= r.probability <= 1 for r in rows)
    assert all(c == pytest.approx(part[0]) for c in part)
    assert all(r.weight * part[0] >= 1 - 1e-9 for r in rows if part and r.probability == 1)


def test_one_rare_source_leaves_the_kept_share(spark):
    """A source of one short document has a weight far above all others."""
    rows = [(i, f"word {i} " + "text " * 40, "abc"[i % 3], "en") for i in range(3_000)]
    rows.append((9_999, "rare " * 5, "rare", "en"))
    kept = M.sample(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).count()
    assert 0.46 * len(rows) < kept < 0.54 * len(rows)


def test_cells_without_weight_do_not_fill_the_budget(spark):
    cells = spark.createDataFrame([("a", 10, 0.5), ("b", 90, 0.0), ("c", 0, 1.0)], "source string, tokens long, weight double")
    got = {r.source: r.probability for r in M.to_budget(cells, 0.5).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 1.0}
    assert M.to_budget(cells.limit(0)).count() == 0
