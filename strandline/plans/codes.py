"""Vocabularies, code sets, code maps and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandline.operators import codes as C
from strandline.operators.contracts import require
from strandline.plans.bindings import (
    DEVELOPMENT_YEARS,
    FLAGS,
    INDEX_PREFIXES,
    SECOND_CODES,
    UNMAPPED_PROCEDURE,
    admissions,
    code_sets,
    encoded,
    known_principal,
    sql_in,
    table,
    vocabularies,
    vocabulary,
)
from strandline.plans.registry import cte, query, rnd, sql

YEARS = (1995, 1996, 1997, 1998)


# vocabulary -----------------------------------------------------------------------

@query("vocabulary_fit", sql("SELECT side, code, first_year, n, id FROM vocab", "vocab"))
def vocabulary_fit(spark, sf_dir):
    return vocabularies(spark, sf_dir).select("side", "code", "first_year", "n", "id")


@query("encoded_arrays", sql("SELECT enc_id, dx_ids, pr_ids FROM encoded", "encoded"))
def encoded_arrays(spark, sf_dir):
    return encoded(spark, sf_dir).select("enc_id", "dx_ids", "pr_ids")


cte(
    "common_codes",
    "SELECT code, id FROM vocab WHERE side = 'dx' AND n >= (SELECT avg(n) FROM vocab WHERE side = 'dx')",
    "vocab",
)


@query(
    "unseen_code_audit",
    sql(
        "SELECT code, count(*) AS n FROM code_rows WHERE side = 'dx' AND code <> '' AND code NOT IN (SELECT code FROM common_codes) GROUP BY 1",
        "common_codes",
    ),
)
def unseen_code_audit(spark, sf_dir):
    """Codes outside a frozen vocabulary that kept the more common half, with their frequency."""
    rows = C.code_rows(admissions(spark, sf_dir), ["enc_id", "year"], "dx")
    fitted = vocabulary(spark, sf_dir, "dx")
    frozen = fitted.where(F.col("n") >= F.lit(fitted.agg(F.avg("n")).first()[0]))
    return C.unseen_audit(C.encode_rows(rows, frozen))


@query(
    "vocabulary_integrity",
    sql(
        """SELECT side, count(*) - count(DISTINCT id) AS repeated_ids, count(*) - count(DISTINCT code) AS repeated_codes,
  count(*) FILTER (WHERE id < 4) AS reserved_ids_used, max(id) - 3 - count(*) AS gaps FROM vocab GROUP BY 1""",
        "vocab",
    ),
)
def vocabulary_integrity(spark, sf_dir):
    faults = [
        C.vocabulary_faults(vocabulary(spark, sf_dir, side)).select(F.lit(side).alias("side"), "*") for side in ("dx", "pr")
    ]
    return faults[0].unionByName(faults[1])


@query(
    "frequent_codes",
    sql(
        """SELECT id, n, row_number() OVER (ORDER BY id) - 1 AS "column" FROM
 (SELECT id, count(DISTINCT enc_id) AS n FROM id_rows WHERE side = 'dx' AND id > 3 AND year <= 1998 GROUP BY 1)
WHERE n >= (SELECT count(*) // 70 FROM encoded)""",
        "id_rows",
        "encoded",
    ),
)
def frequent_codes(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    minimum = enc.count() // 70
    return C.frequent_codes(enc.where("year <= 1998"), "dx_ids", minimum)


# reference tables: catalogue, map, specification --------------------------------------

def catalogue(spark, sf_dir):
    """Billable codes per year; a few codes leave the catalogue later."""
    part = table(spark, sf_dir, "part")
    digit = F.pmod("p_partkey", F.lit(10)).cast("string")
    dx = part.select(F.lit("CM").alias("system"), F.concat(F.col("p_type"), digit).alias("code")).distinct()
    pr = part.select(F.lit("PCS").alias("system"), F.upper("p_brand").alias("code")).distinct()
    years = F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year")
    rows = dx.unionByName(pr).select("*", years)
    gone = (F.col("year") >= 1997) & F.col("code").endswith("7")
    return rows.where(~gone).withColumn("description", F.concat_ws(" ", F.lit("as of"), F.col("year").cast("string"), "code"))


def code_mapping(spark, sf_dir):
    """Category and domain per code; codes ending in 9 have none."""
    rows = catalogue(spark, sf_dir).where(~F.col("code").endswith("9"))
    category = F.when(
        F.col("system") == "CM", F.concat(F.substring("code", 1, 3), (F.right("code", F.lit(1)).cast("int") % 3).cast("string"))
    ).otherwise(F.concat(F.lit("B"), F.length("code").cast("string")))
    return rows.select("year", "system", "code", category.alias("category"), F.substring(category, 1, 3).alias("domain"))


cte(
    "catalogue",
    f"""SELECT system, code, year, 'as of ' || year || ' ' || code AS description FROM
(SELECT DISTINCT 'CM' AS system, p_type || (p_partkey % 10) AS code FROM part UNION ALL SELECT DISTINCT 'PCS', upper(p_brand) FROM part)
CROSS JOIN (SELECT unnest([{', '.join(map(str, YEARS))}])::INT AS year)
WHERE NOT (year >= 1997 AND right(code, 1) = '7')""",
)
cte(
    "mapping",
    """SELECT year, system, code, category, substr(category, 1, 3) AS domain FROM (SELECT *,
  CASE WHEN system = 'CM' THEN substr(code, 1, 3) || (right(code, 1)::INT % 3) ELSE 'B' || length(code) END AS category
  FROM catalogue WHERE right(code, 1) <> '9')""",
    "catalogue",
)

# A specification of code sets, by category or by single code.
SPECIFICATION = (
    ("T1", "PCS", "category", "B7", True),
    ("T2", "CM", "category", "STA1", True),
    ("T2", "CM", "code", "PROMO7", True),
    ("T2", "CM", "code", "NOSUCH1", True),
    ("T3", "PCS", "code", "BRAND#3", True),
    ("T3", "PCS", "category", "B8", False),
    ("T4", "CM", "category", "SMA0", True),
    ("T4", "CM", "code", "SMALL0", True),
)
cte(
    "specs",
    "SELECT y.year, s.* FROM (VALUES "
    + ", ".join(f"('{t}', '{s}', '{k}', '{v}', {str(a).lower()})" for t, s, k, v, a in SPECIFICATION)
    + f") s(\"table\", system, kind, value, active) CROSS JOIN (SELECT unnest([{', '.join(map(str, YEARS))}])::INT AS year) y",
)


def specification(spark):
    rows = spark.createDataFrame(
        [(y, *row) for y in YEARS for row in SPECIFICATION],
        "year int, table string, system string, kind string, value string, active boolean",
    )
    return rows


@query(
    "code_set_expansion",
    sql(
        """SELECT DISTINCT x.year, x."table", x.system, x.code FROM (
  SELECT s.year, s."table", s.system, m.code FROM specs s JOIN mapping m ON m.year = s.year AND m.system = s.system AND m.category = s.value
    WHERE s.active AND s.kind = 'category'
  UNION ALL SELECT year, "table", system, value FROM specs WHERE active AND kind = 'code') x
JOIN catalogue c ON c.year = x.year AND c.system = x.system AND c.code = x.code""",
        "specs",
        "mapping",
        "catalogue",
    ),
)
def code_set_expansion(spark, sf_dir):
    return C.expand_code_sets(specification(spark), code_mapping(spark, sf_dir), catalogue(spark, sf_dir).drop("description"))


@query(
    "codes_outside_catalogue",
    sql(
        """SELECT year, "table", system, value AS code FROM specs s WHERE active AND kind = 'code'
  AND NOT EXISTS (SELECT 1 FROM catalogue c WHERE c.year = s.year AND c.system = s.system AND c.code = s.value)""",
        "specs",
        "catalogue",
    ),
)
def codes_outside_catalogue(spark, sf_dir):
    return C.direct_codes_outside(specification(spark), catalogue(spark, sf_dir).select("year", "system", "code"))


@query(
    "first_unmapped_codes",
    sql(
        """SELECT DISTINCT c.code FROM catalogue c WHERE system = 'CM' AND NOT EXISTS
  (SELECT 1 FROM mapping m WHERE m.code = c.code) ORDER BY code LIMIT 20""",
        "catalogue",
        "mapping",
    ),
)
def first_unmapped_codes(spark, sf_dir):
    mapped = code_mapping(spark, sf_dir).select("code")
    missing = catalogue(spark, sf_dir).where("system = 'CM'").select("code").join(mapped, "code", "left_anti")
    return missing.distinct().orderBy("code").limit(20)


@query(
    "code_set_ids",
    sql(
        """SELECT p_type AS label, list_sort(list(v.id) FILTER (WHERE v.id IS NOT NULL)) AS ids, count(*) AS source_codes, count(v.id) AS known_codes
FROM (SELECT DISTINCT p_type, p_type || (p_partkey % 10) AS code FROM part
      UNION SELECT DISTINCT p_type, 'OLD' || p_type FROM part) s
LEFT JOIN (SELECT * FROM vocab WHERE side = 'dx') v USING (code) GROUP BY 1""",
        "vocab",
    ),
)
def code_set_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    digit = F.pmod("p_partkey", F.lit(10)).cast("string")
    listed = part.select(F.col("p_type").alias("label"), F.concat(F.lower("p_type"), F.lit("."), digit).alias("code"))
    listed = listed.unionByName(part.select(F.col("p_type").alias("label"), F.concat(F.lit("old"), F.col("p_type")).alias("code")))
    return C.code_set_ids(listed, vocabulary(spark, sf_dir, "dx"), ["label"])


@query(
    "ontology_labels",
    sql(
        """SELECT 'cause.second' AS label, CASE WHEN code LIKE 'LARGE%' THEN 'large' ELSE 'medium' END AS subtype, 2 AS priority, code,
  arg_max(description, year) AS description, string_agg(DISTINCT year::VARCHAR, ';' ORDER BY year::VARCHAR) AS valid_years
FROM catalogue WHERE system = 'CM' AND (code LIKE 'LARGE%' OR code LIKE 'MEDIUM%') GROUP BY code""",
        "catalogue",
    ),
)
def ontology_labels(spark, sf_dir):
    code = F.col("code")
    subtype = F.when(code.startswith("LARGE"), "large").when(code.startswith("MEDIUM"), "medium")
    return C.ontology_rows(catalogue(spark, sf_dir).where("system = 'CM'"), "cause.second", subtype, 2)


@query(
    "unfounded_code_claims",
    sql(
        """SELECT system, code, year FROM (SELECT DISTINCT system, code FROM catalogue)
CROSS JOIN (SELECT unnest([1996, 1998])::INT AS year)
WHERE (system, code, year) NOT IN (SELECT (system, code, year) FROM catalogue)""",
        "catalogue",
    ),
)
def unfounded_code_claims(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    book = cat.select("system", "code").distinct().withColumn("years", F.lit("1996;1998;"))
    return C.unfounded_claims(book, cat)


@query(
    "category_lists",
    sql(
        "SELECT system, domain, string_agg(DISTINCT category, ';' ORDER BY category) AS categories FROM mapping GROUP BY 1, 2", "mapping"
    ),
)
def category_lists(spark, sf_dir):
    return code_mapping(spark, sf_dir).groupBy("system", "domain").agg(
        F.concat_ws(";", F.array_sort(F.collect_set("category"))).alias("categories")
    )


@query(
    "code_map_consistency",
    sql(
        """SELECT system, code, min(category) AS category FROM mapping GROUP BY 1, 2""",
        "mapping",
    ),
)
def code_map_consistency(spark, sf_dir):
    return C.code_map(code_mapping(spark, sf_dir), ["system", "code"], "category")


cte(
    "hier",
    """SELECT v.code, v.id, m.category, m.domain,
  CASE WHEN m.category IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY m.category NULLS LAST) END::INT AS category_id,
  CASE WHEN m.domain IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY m.domain NULLS LAST) END::INT AS domain_id
FROM (SELECT * FROM vocab WHERE side = 'dx') v LEFT JOIN (SELECT DISTINCT code, category, domain FROM mapping WHERE system = 'CM') m USING (code)""",
    "vocab",
    "mapping",
)


def hierarchy(spark, sf_dir):
    mapping = code_mapping(spark, sf_dir).where("system = 'CM'").select("code", "category", "domain").distinct()
    return C.encode_hierarchy(vocabulary(spark, sf_dir, "dx"), mapping)


@query("code_hierarchy", sql("SELECT code, id, category, domain, category_id, domain_id FROM hier", "hier"))
def code_hierarchy(spark, sf_dir):
    return hierarchy(spark, sf_dir)


@query(
    "hierarchy_coverage",
    sql(
        """SELECT count(*) AS codes, count(category) AS mapped, round(count(category) / count(*)::DOUBLE, 6) AS coverage,
  CASE WHEN count(category) / count(*)::DOUBLE >= 0.95 THEN 'PASS' ELSE 'REVIEW' END AS status FROM hier""",
        "hier",
    ),
)
def hierarchy_coverage(spark, sf_dir):
    out = C.hierarchy_coverage(hierarchy(spark, sf_dir))
    return out.withColumn("coverage", rnd(F.col("coverage")))


@query(
    "unified_id_space",
    sql(
        """SELECT side, code, (id + CASE WHEN side = 'pr' THEN (SELECT max(id) + 1 FROM vocab WHERE side = 'dx') ELSE 0 END)::INT AS unified_id FROM vocab""",
        "vocab",
    ),
)
def unified_id_space(spark, sf_dir):
    """The second vocabulary moved behind the first one."""
    both = vocabularies(spark, sf_dir)
    size = both.where("side = 'dx'").agg(F.max("id") + 1).first()[0]
    shift = F.when(F.col("side") == "pr", F.lit(size)).otherwise(F.lit(0))
    return both.select("side", "code", (F.col("id") + shift).cast("int").alias("unified_id"))


# flags ----------------------------------------------------------------------------

@query("flag_table", sql(f"SELECT enc_id, {', '.join(FLAGS)} FROM adm", "adm"))
def flag_table(spark, sf_dir):
    return admissions(spark, sf_dir).select("enc_id", *FLAGS)


@query(
    "planned_status_counts",
    sql("SELECT year, planned_status, count(*) AS n, count(DISTINCT entity_id) AS entities FROM adm GROUP BY 1, 2", "adm"),
)
def planned_status_counts(spark, sf_dir):
    return admissions(spark, sf_dir).groupBy("year", "planned_status").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("entities")
    )


@query(
    "code_membership_by_join",
    sql(
        """SELECT enc_id, list_has_any(dx, (SELECT list(DISTINCT code) FROM catalogue WHERE system = 'CM' AND code LIKE 'LARGE%' AND right(code, 1) < '5')) AS any_listed FROM adm""",
        "adm",
        "catalogue",
    ),
)
def code_membership_by_join(spark, sf_dir):
    """Membership in a code list that is a table: explode, semi-join, mark."""
    listed = catalogue(spark, sf_dir).where("system = 'CM' AND code LIKE 'LARGE%' AND right(code, 1) < '5'").select("code").distinct()
    adm = admissions(spark, sf_dir).select("enc_id", "dx")
    hit = C.lookup_join(adm.select("enc_id", F.explode("dx").alias("code")), listed, ["code"], "left_semi")
    hit = hit.select("enc_id").distinct().withColumn("any_listed", F.lit(True))
    return adm.join(hit, "enc_id", "left").select("enc_id", F.coalesce("any_listed", F.lit(False)).alias("any_listed"))


@query(
    "code_prefix_membership",
    sql(f"SELECT enc_id, any_1, principal_1, principal IN {sql_in(SECOND_CODES)} AS exact FROM adm", "adm"),
)
def code_prefix_membership(spark, sf_dir):
    adm = admissions(spark, sf_dir)
    starts = [F.col("principal").startswith(p) for p in INDEX_PREFIXES]
    return adm.select(
        "enc_id",
        F.exists("dx", lambda c: reduce(lambda a, b: a | b, [c.startswith(p) for p in INDEX_PREFIXES])).alias("any_1"),
        reduce(lambda a, b: a | b, starts).alias("principal_1"),
        F.col("principal").isin(SECOND_CODES).alias("exact"),
    )


RULE_YEARS = (1996, 1997, 1998, 1999, 2000)
_STATES = " UNION ALL ".join(
    f"""SELECT enc_id, {y} AS rule_year, CASE WHEN principal = '' OR right(principal, 1) = '9' OR ({y} >= 2000 AND right(principal, 1) = '8')
   OR unknown_procedures > 0 THEN -1 WHEN (p1 AND list_has_any(pr, ['BRAND#1', 'BRAND#2']))
   OR ({y} >= 1998 AND list_contains(pr, 'BRAND#7')) OR p2 OR (p3 AND NOT p4) THEN 1 ELSE 0 END AS state FROM adm"""
    for y in RULE_YEARS
)
cte(
    "consensus",
    f"""SELECT enc_id, CASE WHEN bool_and(state = 1) THEN 'stable_planned' WHEN bool_and(state = 0) THEN 'stable_unplanned'
  ELSE 'algorithm_unknown' END AS consensus FROM ({_STATES}) GROUP BY 1""",
    "adm",
)


def rule_states(adm, years=RULE_YEARS):
    """The planned rule of every rule year on each row."""
    yearly = adm.select("enc_id", "principal", "pr", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"))
    principal = F.col("principal")
    rule = C.planned_columns(principal, F.col("pr"), code_sets(), known_principal(principal), lambda c: c != UNMAPPED_PROCEDURE)
    return yearly.select("enc_id", "year", rule["planned_status"].alias("state"))


@query("five_year_consensus", sql("SELECT enc_id, consensus FROM consensus", "consensus"))
def five_year_consensus(spark, sf_dir):
    return C.consensus(rule_states(admissions(spark, sf_dir)), ["enc_id"], "state", len(RULE_YEARS))


@query("cause_priority", sql("SELECT cause_code, count(*) AS n FROM adm GROUP BY 1", "adm"))
def cause_priority(spark, sf_dir):
    adm = admissions(spark, sf_dir)
    flags = [F.col(f"principal_{k}") for k in (1, 2, 3)]
    require(adm, {"cause": C.cause_code(flags) == F.col("cause_code")})
    return adm.groupBy("cause_code").agg(F.count(F.lit(1)).alias("n"))
