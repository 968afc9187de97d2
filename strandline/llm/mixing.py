"""Mixing to target weights by iterative proportional fitting, in DataFrame code alone.

Documents are added up to cells (source, language, topic) of tokens.  Each sweep
scales the cells to the target of one dimension after the other, until all
marginals agree; the ratio of a cell's raked weight to its tokens is the weight
of its documents.  A draw depends on the id and a seed only.

``sample`` draws to a token budget, the share ``SHARE`` of all tokens: the
probability is a constant times the weight, at most one, and the constant is
solved so that the expected tokens are the budget.  Cells whose probability is
one are kept whole, and the others share what is left; a small cell of large
weight thus takes its own tokens from the rest and no more.  Where the cells with
a weight hold fewer tokens than the budget, all of them are kept.

Targets of several dimensions may contradict each other; no weights meet them
then, and the sweeps end at their limit.  ``converged`` tells whether every
marginal agrees within the tolerance, and ``sample`` takes ``strict`` to stop
instead.  The topic is an input like source and language; where a table has none,
``topic_of`` stands in for it.

Only the cells are swept, which are written to the shared folder every sweep;
documents meet them in a join that is a broadcast only below a checked size.

Defined cases: a null level is a level of its own, named ``(none)``.  Targets are
shares over the levels that occur; they are scaled to add up to one, and a level
without a target gets none.  A null or empty text has no tokens; a cell without
tokens cannot be raked and has weight one.  Rows with one id are drawn together.
Empty tables give empty results.  Working columns take names the input lacks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandline.operators.skew import lookup_join
from strandline.session import materialise

DIMENSIONS = ("source", "lang", "topic")
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
SHARE = 0.5  # of all tokens, the budget of a sample
SWEEPS, TOLERANCE = 50, 1e-6
SEED = "mix-1"
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse kind of text from what it holds and how long it is."""
    body = F.coalesce(text, F.lit(""))
    return (
        F.when(body.contains("@"), "contact")
        .when(F.lower(body).contains("license"), "legal")
        .when(F.length(body) < 600, "note")
        .when(F.length(body) < 6000, "article")
        .otherwise("long")
    )


def level(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(NONE))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(level, share): shares of tokens, evened out by a power below one."""
    sums = cells.groupBy(F.col(dimension).alias("level")).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    return sums.select("level", F.pow("t", F.lit(power)).alias("share"))


def rake(
    cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE
) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``, raked tokens over tokens, and ``converged``."""
    names = list(targets)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    found = cells.where("tokens > 0").withColumn("raked", F.col("tokens").cast("double"))
    for name, target in targets.items():
        present = target.join(found.select(F.col(name).alias("level")).distinct(), "level", "left_semi")
        whole = present.agg(F.sum("share")).first()[0] or 1.0
        goal = (F.col("share") / whole * total).alias(f"goal_{name}")
        found = found.join(present.select(F.col("level").alias(name), goal), name, "left").na.fill(0.0, [f"goal_{name}"])
    found = materialise(found, "cells")
    held, deviation = found.columns, 0.0
    for _ in range(sweeps):
        swept, off = found, []
        for name in names:
            sums = swept.groupBy(name, f"goal_{name}").agg(F.sum("raked").alias("now"))
            ratio = F.coalesce(F.col(f"goal_{name}") / F.when(F.col("now") > 0, F.col("now")), F.lit(0.0))
            swept = swept.join(sums.select(name, ratio.alias(f"ratio_{name}")), name)
            swept = swept.withColumn("raked", F.col("raked") * F.col(f"ratio_{name}"))
            off.append(F.abs(F.col(f"ratio_{name}") - 1))
        worst, seen = F.greatest(*off) if len(off) > 1 else off[0], Observation()
        swept = swept.observe(seen, F.max(F.when(F.col("raked") > 0, worst)).alias("worst"))
        found = materialise(swept.select(*held), "cells")
        deviation = seen.get["worst"] or 0.0
        if deviation <= tolerance:
            break
    weighed = cells.where("tokens = 0").withColumn("weight", F.lit(1.0)).unionByName(
        found.select(*cells.columns, (F.col("raked") / F.col("tokens")).alias("weight"))
    )
    return materialise(weighed.withColumn("converged", F.lit(deviation <= tolerance)), "weights")


def draw(id_value: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id and the seed."""
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_value.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(name, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cells_of(docs: DataFrame, dimensions: Mapping[str, Column], tokens: Column) -> DataFrame:
    """Tokens by cell; rows are added up before they move."""
    rows = docs.select(*[level(c).alias(n) for n, c in dimensions.items()], tokens.alias("tokens"))
    return rows.groupBy(*dimensions).agg(F.sum("tokens").alias("tokens"))


def mix(
    docs: DataFrame,
    dimensions: Mapping[str, Column],
    tokens: Column,
    targets: Mapping[str, DataFrame] | None = None,
    powers: Mapping[str, float] = POWERS,
    **limits,
) -> DataFrame:
    """Cells with their weight, raked to ``targets`` or to tempered shares."""
    cells = materialise(cells_of(docs, dimensions, tokens), "cells")
    return rake(cells, targets or {n: tempered(cells, n, powers[n]) for n in dimensions}, **limits)


def to_budget(cells: DataFrame, share: float = SHARE) -> DataFrame:
    """``cells`` with the ``probability`` at which the expected tokens are ``share`` of all.

    Each round keeps the cells whole that the constant would draw more than once
    and solves for the others; cells only ever join the whole ones, so it ends.
    """
    tokens, weight = F.col("tokens"), F.col("weight")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    constant, whole = 0.0, -1
    while True:
        # a cell once kept whole stays so: the constant never falls
        capped = weight * F.lit(constant) >= 1
        seen = cells.where("tokens > 0 AND weight > 0").agg(
            F.count_if(capped).alias("whole"),
            F.sum(F.when(capped, tokens)).alias("held"),
            F.sum(F.when(~capped, tokens * weight)).alias("rest"),
        ).first()
        if not seen["rest"]:
            constant = float("inf")
            break
        if seen["whole"] == whole:
            break
        whole = seen["whole"]
        constant = max(constant, (share * total - (seen["held"] or 0)) / seen["rest"])
    chance = F.when(weight > 0, F.least(F.lit(1.0), weight * F.lit(constant))).otherwise(0.0)
    return cells.withColumn("probability", chance)


def with_weights(docs: DataFrame, cells: DataFrame, dimensions: Mapping[str, Column], prefix: str = "_") -> DataFrame:
    """``docs`` with its cell's ``weight``, ``probability`` and ``converged``, all behind ``prefix``."""
    keys = {f"{prefix}{n}": level(c) for n, c in dimensions.items()}
    right = cells.select(*[F.col(n).alias(f"{prefix}{n}") for n in dimensions], *[F.col(n).alias(f"{prefix}{n}") for n in ("weight", "probability", "converged")])
    return lookup_join(docs.withColumns(keys), right, list(keys), "inner")


def sample(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", text_col: str = "text", seed: str = SEED, share: float = SHARE, topic: Column | None = None, strict: bool = False, **limits
) -> DataFrame:
    """The documents drawn, ``share`` of all tokens, with all their columns and ``mix_weight``.

    ``strict`` makes targets that cannot all be met an error.
    """
    dimensions = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic_of(F.col(text_col)) if topic is None else topic}
    cells = mix(docs, dimensions, token_count(F.col(text_col)), **limits)
    if strict and not cells.where("NOT converged").isEmpty():
        raise ValueError("the targets contradict each other, or need more sweeps")
    cells = to_budget(cells, share)
    prefix = "_mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    drawn = with_weights(docs, cells, dimensions, prefix).where(draw(F.col(id_col), seed) < F.col(f"{prefix}probability"))
    kept = [c for c in docs.columns if c != "mix_weight"]
    return drawn.select(*kept, F.round(f"{prefix}weight", 6).alias("mix_weight"))


def mix_sql(powers: Mapping[str, float] = POWERS, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, seed: str = SEED, share: float = SHARE) -> str:
    """Weights, probabilities and draws of all ``documents``, for DuckDB."""
    goals = ",\n".join(
        f"g_{n} AS (SELECT {n}, pow(t, {p}::DOUBLE) / sum(pow(t, {p}::DOUBLE)) OVER () * (SELECT sum(tokens) FROM cells) AS goal_{n}"
        f" FROM (SELECT {n}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY 1) WHERE t > 0)"
        for n, p in powers.items()
    )
    step, keep = "(SELECT * FROM r WHERE i < {} AND worst > {})".format(sweeps, tolerance), ""
    for n in powers:
        step = f"(SELECT * REPLACE (raked * q_{n} AS raked) FROM (SELECT x.*, goal_{n} / sum(raked) OVER (PARTITION BY x.{n}) AS q_{n} FROM {step} x JOIN g_{n} ON x.{n} = g_{n}.{n}))"
        keep += f"{', ' if keep else ''}abs(q_{n} - 1)"
    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN contains(body, '@') THEN 'contact' WHEN contains(lower(body), 'license') THEN 'legal'
         WHEN length(body) < 600 THEN 'note' WHEN length(body) < 6000 THEN 'article' ELSE 'long' END AS topic,
    len(regexp_extract_all(body, '{WORD}'))::BIGINT AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS body FROM documents)),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{goals},
r AS (SELECT source, lang, topic, tokens, tokens::DOUBLE AS raked, 1e300::DOUBLE AS worst, 0 AS i FROM cells WHERE tokens > 0
  UNION ALL SELECT source, lang, topic, tokens, raked, max(greatest({keep})) OVER (), i + 1 FROM {step}),
w AS (SELECT source, lang, topic, raked / tokens AS weight FROM r WHERE i = (SELECT max(i) FROM r)
  UNION ALL SELECT source, lang, topic, 1 FROM cells WHERE tokens = 0),
ranked AS (SELECT tokens, weight, coalesce(sum(tokens) OVER (best ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(tokens * weight) OVER (best ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER best AS k
  FROM w JOIN cells USING (source, lang, topic) WHERE tokens > 0 AND weight > 0 WINDOW best AS (ORDER BY weight DESC)),
solved AS (SELECT ({share} * (SELECT sum(tokens) FROM cells) - held) / rest AS constant, weight, k FROM ranked),
p AS (SELECT *, CASE WHEN weight > 0 THEN least(1, weight * coalesce((SELECT constant FROM solved WHERE weight * constant < 1 ORDER BY k LIMIT 1), 'Infinity'::DOUBLE)) ELSE 0 END AS probability,
  coalesce((SELECT max(worst) FROM r WHERE i = (SELECT max(i) FROM r)), 0) <= {tolerance} AS converged FROM w)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / pow(2, 52) < probability AS kept, converged
FROM d JOIN p USING (source, lang, topic)"""
