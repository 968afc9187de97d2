"""Driver tables read in the roles the operators expect.

Orders stand for encounters, customers for entities, order lines for code
positions, suppliers for facilities, events for timestamp stays, labelled
documents for scored rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.arrays import any_in, any_prefix
from strandline.functions.text import normalize_code
from strandline.functions.values import sigmoid
from strandline.layout import FIRST_CODE_ID
from strandline.operators.codes import cause_code, code_rows, encode_arrays, fit_vocabulary, planned_columns
from strandline.operators.ordering import order_number
from strandline.operators.skew import keyed_join, lookup_join
from strandline.plans.registry import cte
from strandline.plans.stages import staged

INDEX_PREFIXES = ("ECONOMY", "PROMO")
SECOND_CODES = [f"LARGE{i}" for i in range(5)]
THIRD_CODES = [f"MEDIUM{i}" for i in range(5)] + ["SMALL0", "SMALL1"]
P1_CODES = ["BRAND#1", "BRAND#2"]
P1_LATER = "BRAND#7"
P2_CODES = ["STANDARD0", "STANDARD1"]
P3_CODES = ["BRAND#3", "BRAND#4", "BRAND#5"]
P4_CODES = [f"SMALL{i}" for i in range(5)] + ["LARGE0", "LARGE1", "LARGE2"]
UNMAPPED_PROCEDURE = "BRAND#25"
DEVELOPMENT_YEARS = (1995, 1996, 1997, 1998)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


# encounters -----------------------------------------------------------------

def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    mod = lambda c, n: F.pmod(c, F.lit(n)).cast("int")
    priority = F.col("o_orderpriority")
    return o.select(
        key.alias("enc_id"),
        cust.alias("entity_id"),
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        F.datediff(date, F.lit("1995-01-01").cast("date")).alias("start_day"),
        mod(key, 8).alias("stay"),
        (15 + mod(cust * 13, 80)).alias("age"),
        mod(cust, 2).alias("female"),
        F.when(mod(cust, 7) < 6, mod(cust, 7)).alias("payer"),
        (mod(key, 29) == 0).cast("int").alias("died"),
        mod(key, 21).alias("disposition"),
        (priority == "1-URGENT").cast("int").alias("emergency"),
        F.when(priority == "5-LOW", 1).when(priority != "4-NOT SPECIFIED", 0).alias("elective"),
        F.when(mod(key, 6) < 5, mod(key, 6)).alias("severity"),
        mod(key * 7, 5).alias("risk"),
        F.col("o_totalprice").alias("charge"),
        (1 + mod(cust, 25) / 10.0).alias("weight"),
    )


cte(
    "enc",
    """SELECT o_orderkey AS enc_id, o_custkey AS entity_id,
  year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS start_day,
  (o_orderkey % 8)::INT AS stay, (15 + (o_custkey * 13) % 80)::INT AS age,
  (o_custkey % 2)::INT AS female,
  CASE WHEN o_custkey % 7 < 6 THEN (o_custkey % 7)::INT END AS payer,
  CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS died,
  (o_orderkey % 21)::INT AS disposition,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS emergency,
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 0 END AS elective,
  CASE WHEN o_orderkey % 6 < 5 THEN (o_orderkey % 6)::INT END AS severity,
  ((o_orderkey * 7) % 5)::INT AS risk, o_totalprice AS charge,
  1 + (o_custkey % 25) / 10.0::DOUBLE AS weight
FROM orders""",
)


# codes ----------------------------------------------------------------------

def line_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw codes of every order line."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(F.lower("p_type"), F.lit("."), F.pmod("p_partkey", F.lit(10)).cast("string")).alias("dx"),
        F.col("p_brand").alias("pr"),
    )
    supplier_mod = F.pmod("l_suppkey", F.lit(10))
    day = (
        F.when(supplier_mod == 0, -99)
        .when(supplier_mod == 1, F.lit(None).cast("int"))
        .when(supplier_mod == 2, -66)
        .otherwise(F.pmod("l_partkey", F.lit(12)).cast("int") - 2)
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day.alias("prday"))
    return lookup_join(lines, part, ["l_partkey"], "inner")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")


def encounter_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all lines of an encounter as arrays.

    Positions follow (line number, part, supplier).  A line stays one struct
    until all are in order, so its codes, day and facility belong together.
    """
    slots = line_codes(spark, sf_dir).groupBy(F.col("l_orderkey").alias("enc_id")).agg(
        F.sort_array(F.collect_list(F.struct(*LINE_ORDER, "dx", "pr", "prday"))).alias("s")
    )
    return slots.select(
        "enc_id",
        F.transform("s.dx", normalize_code).alias("dx"),
        F.transform("s.pr", normalize_code).alias("pr"),
        F.col("s.prday").alias("prday"),
        F.get("s.l_suppkey", F.lit(0)).alias("facility_id"),
    )


cte(
    "lines",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  lower(p_type) || '.' || (p_partkey % 10) AS dx, p_brand AS pr,
  CASE l_suppkey % 10 WHEN 0 THEN -99 WHEN 1 THEN NULL WHEN 2 THEN -66
       ELSE (l_partkey % 12)::INT - 2 END AS prday
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
_LINES = ", ".join(LINE_ORDER)
cte(
    "codes",
    f"""SELECT l_orderkey AS enc_id,
  list(upper(replace(dx, '.', '')) ORDER BY {_LINES}) AS dx,
  list(upper(pr) ORDER BY {_LINES}) AS pr,
  list(prday ORDER BY {_LINES}) AS prday,
  first(l_suppkey ORDER BY {_LINES}) AS facility_id
FROM lines GROUP BY 1""",
    "lines",
)


def code_sets() -> dict[str, Column]:
    """Code lists of the planned rule; the first one grows from 1998 on."""
    return {
        "p1": F.when(F.col("year") >= 1998, lits([*P1_CODES, P1_LATER])).otherwise(lits(P1_CODES)),
        "p2": lits(P2_CODES),
        "p3": lits(P3_CODES),
        "p4": lits(P4_CODES),
    }


def known_principal(principal: Column) -> Column:
    return ~principal.endswith("9") & ~((F.col("year") >= 2000) & principal.endswith("8"))


def flag_columns(principal: Column, dx: Column, pr: Column) -> dict[str, Column]:
    principal_flags = [
        any_prefix(F.array(principal), INDEX_PREFIXES),
        principal.isin(SECOND_CODES),
        principal.isin(THIRD_CODES),
    ]
    return {
        "principal_1": principal_flags[0],
        "any_1": any_prefix(dx, INDEX_PREFIXES),
        "principal_2": principal_flags[1],
        "any_2": any_in(dx, SECOND_CODES),
        "principal_3": principal_flags[2],
        "any_3": any_in(dx, THIRD_CODES),
        "cause_code": cause_code(principal_flags),
        **planned_columns(principal, pr, code_sets(), known_principal(principal), lambda c: c != UNMAPPED_PROCEDURE),
    }


FLAGS = (
    "principal_1", "any_1", "principal_2", "any_2", "principal_3", "any_3", "cause_code",
    "p1", "p2", "p3", "p4", "unknown_principal", "unknown_procedures", "planned_unknown", "planned_status",
)


@staged
def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters with code arrays and the flag table."""
    no_text = F.array().cast("array<string>")
    adm = keyed_join(encounters(spark, sf_dir), encounter_codes(spark, sf_dir), ["enc_id"], "left")
    adm = adm.withColumns({"dx": F.coalesce("dx", no_text), "pr": F.coalesce("pr", no_text)})
    adm = adm.withColumn("principal", F.coalesce(F.get("dx", F.lit(0)), F.lit("")))
    return adm.withColumns(flag_columns(F.col("principal"), F.col("dx"), F.col("pr")))


cte(
    "adm",
    f"""SELECT *, (p1 OR p2 OR (p3 AND NOT p4)) AS planned_rule,
  (unknown_principal OR unknown_procedures > 0) AS planned_unknown,
  CASE WHEN unknown_principal OR unknown_procedures > 0 THEN -1
       WHEN p1 OR p2 OR (p3 AND NOT p4) THEN 1 ELSE 0 END AS planned_status,
  CASE WHEN principal_1 THEN 1 WHEN principal_2 THEN 2 WHEN principal_3 THEN 3 ELSE 4 END AS cause_code
FROM (SELECT *,
    regexp_matches(principal, '^({"|".join(INDEX_PREFIXES)})') AS principal_1,
    len(list_filter(dx, lambda x: regexp_matches(x, '^({"|".join(INDEX_PREFIXES)})'))) > 0 AS any_1,
    principal IN {sql_in(SECOND_CODES)} AS principal_2, list_has_any(dx, {sql_list(SECOND_CODES)}) AS any_2,
    principal IN {sql_in(THIRD_CODES)} AS principal_3, list_has_any(dx, {sql_list(THIRD_CODES)}) AS any_3,
    list_has_any(pr, CASE WHEN year >= 1998 THEN {sql_list([*P1_CODES, P1_LATER])} ELSE {sql_list(P1_CODES)} END) AS p1,
    principal IN {sql_in(P2_CODES)} AS p2, list_has_any(pr, {sql_list(P3_CODES)}) AS p3,
    principal IN {sql_in(P4_CODES)} AS p4,
    (principal = '' OR right(principal, 1) = '9' OR (year >= 2000 AND right(principal, 1) = '8')) AS unknown_principal,
    len(list_filter(pr, lambda x: x = '{UNMAPPED_PROCEDURE}'))::INT AS unknown_procedures
  FROM (SELECT e.*, coalesce(c.dx, []::VARCHAR[]) AS dx, coalesce(c.pr, []::VARCHAR[]) AS pr, c.prday,
          c.facility_id, coalesce(c.dx[1], '') AS principal
        FROM enc e LEFT JOIN codes c USING (enc_id)))""",
    "enc",
    "codes",
)


# scored rows ------------------------------------------------------------------

def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with an outcome and two scores, one of them with many ties."""
    li = table(spark, sf_dir, "lineitem")
    noise = F.pmod(F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729, F.lit(1000)) / 1000.0
    y = (F.col("l_returnflag") == "R").cast("int")
    return li.select(
        F.col("l_orderkey").alias("entity_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("facility_id"),
        F.pmod("l_suppkey", F.lit(25)).cast("int").alias("stratum"),
        F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line_no"),
        (1 + F.pmod("l_suppkey", F.lit(25)) / 10.0).alias("weight"),
        y.alias("y_any"),
        ((y == 1) & (F.col("l_linestatus") == "F")).cast("int").alias("y_part"),
        F.round(0.05 + F.col("l_discount") * 8, 2).alias("p_tied"),
        F.round(sigmoid(2 * noise - 1.5 + 0.4 * y), 4).alias("p_fine"),
        # tells apart lines of one order, number, part and supplier that differ in any column above
        (F.ascii("l_returnflag") * 1_000_000 + F.ascii("l_linestatus") * 1000 + F.round(F.col("l_discount") * 100).cast("int")).alias("variant"),
    )


cte(
    "scored",
    """SELECT l_orderkey AS entity_id, l_partkey AS part_id,
  l_suppkey AS facility_id, (l_suppkey % 25)::INT AS stratum, l_linestatus AS status, l_linenumber AS line_no,
  1 + (l_suppkey % 25) / 10.0::DOUBLE AS weight,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_any,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END AS y_part,
  round(0.05::DOUBLE + l_discount * 8, 2) AS p_tied,
  round(1 / (1 + exp(-(2 * (((l_partkey * 7919 + l_suppkey * 104729) % 1000) / 1000.0::DOUBLE) - 1.5::DOUBLE
    + 0.4::DOUBLE * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)))), 4) AS p_fine,
  ascii(l_returnflag) * 1000000 + ascii(l_linestatus) * 1000 + round(l_discount * 100)::INT AS variant
FROM lineitem""",
)


ROW_ORDER = ("entity_id", "line_no", "part_id", "facility_id")
cte(
    "uniq",
    f"SELECT *, row_number() OVER (ORDER BY {', '.join(ROW_ORDER)}, variant) AS row_id FROM scored",
    "scored",
)


@staged
def unique_lines(spark, sf_dir):
    """All scored lines with a key of their own, for results that depend on a row order.

    The key is the place of the line by order, line number, part, supplier and variant;
    lines that agree in all of these are equal rows.
    """
    return order_number(scored_lines(spark, sf_dir), [], list(ROW_ORDER), "variant", "row_id")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score from their length."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("quality").alias("y"),
        F.col("toxic").alias("y2"),
        "lang",
        "source",
        (1 + F.pmod("doc_id", F.lit(7)) / 4.0).alias("weight"),
        F.round(sigmoid((F.col("n_chars") - 2000) / 4000.0), 6).alias("p"),
    )


cte(
    "docs",
    """SELECT d.doc_id, l.quality AS y, l.toxic AS y2, d.lang, d.source, 1 + (d.doc_id % 7) / 4.0::DOUBLE AS weight,
  round(1 / (1 + exp(-((d.n_chars - 2000) / 4000.0::DOUBLE))), 6) AS p
FROM documents d JOIN labels l USING (doc_id)""",
)


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five class scores per vector, the true class and two groupings.

    The true class gets a higher score on four of five rows.
    """
    e = table(spark, sf_dir, "embeddings")
    hint = lambda k: F.when((F.pmod("label", F.lit(5)) == k) & (F.pmod("vec_id", F.lit(5)) > 0), 3.0).otherwise(0.0)
    raw = [F.exp(6 * F.col("embedding")[k].cast("double") + hint(k)) for k in range(5)]
    total = reduce(lambda a, b: a + b, raw)
    return e.select(
        "vec_id",
        F.pmod("label", F.lit(5)).alias("y"),
        F.pmod("vec_id", F.lit(2)).cast("string").alias("sex"),
        F.concat(F.lit("band"), F.pmod("label", F.lit(3)).cast("string")).alias("band"),
        F.round((raw[1] + raw[2] + raw[3] + raw[4]) / total, 6).alias("p_any"),
        *[F.round(raw[k] / total, 6).alias(f"s{k}") for k in range(5)],
    )


_RAW = [
    f"exp(6 * embedding[{k + 1}]::DOUBLE + CASE WHEN label % 5 = {k} AND vec_id % 5 > 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END)"
    for k in range(5)
]
cte(
    "classes",
    f"""SELECT vec_id, (label % 5)::INT AS y, (vec_id % 2)::VARCHAR AS sex, 'band' || (label % 3) AS band,
  round(({" + ".join(_RAW[1:])}) / ({" + ".join(_RAW)}), 6) AS p_any,
  {", ".join(f"round({r} / ({' + '.join(_RAW)}), 6) AS s{k}" for k, r in enumerate(_RAW))}
FROM embeddings""",
)


# timestamp stays ----------------------------------------------------------------

def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stays of users; the type names the places."""
    ev = table(spark, sf_dir, "events")
    seconds = (F.col("value") * 60).cast("long")
    kind = F.col("event_type")
    begin = F.col("ts").cast("timestamp")
    return ev.select(
        F.col("user_id").alias("subject_id"),
        F.col("event_id").alias("stay_id"),
        begin.alias("begin_ts"),
        F.timestamp_micros(F.unix_micros(begin) + seconds * 1_000_000).alias("end_ts"),
        F.when(kind == "signup", " acute  hospital").when(kind == "view", "Emergency Room").otherwise("home").alias("from_place"),
        F.when(kind == "purchase", "Transfer to other hospital").otherwise("home").alias("to_place"),
        kind.alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


cte(
    "stays",
    """SELECT user_id AS subject_id, event_id AS stay_id, ts AS begin_ts,
  ts + to_seconds(trunc(value * 60)::BIGINT) AS end_ts,
  CASE event_type WHEN 'signup' THEN ' acute  hospital' WHEN 'view' THEN 'Emergency Room' ELSE 'home' END AS from_place,
  CASE event_type WHEN 'purchase' THEN 'Transfer to other hospital' ELSE 'home' END AS to_place,
  event_type AS kind, (props->>'$.k')::INT AS k
FROM events""",
)


# encoded codes ------------------------------------------------------------------

@staged
def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies of both code columns, fitted on the development years."""
    adm = admissions(spark, sf_dir)
    out = []
    for side in ("dx", "pr"):
        rows = code_rows(adm, ["year"], side)
        out.append(fit_vocabulary(rows, "year", DEVELOPMENT_YEARS).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1])


def vocabulary(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    return vocabularies(spark, sf_dir).where(F.col("side") == side).drop("side")


def id_space(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """What moves ids of the second vocabulary behind the first one, and the size of both together."""
    last = {r["side"]: r["m"] for r in vocabularies(spark, sf_dir).groupBy("side").agg(F.max("id").alias("m")).collect()}
    shift = last.get("dx", FIRST_CODE_ID - 1) + 1 - FIRST_CODE_ID
    return shift, shift + last.get("pr", FIRST_CODE_ID - 1) + 1


@staged
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions with ids in place of both code arrays."""
    sides = {side: (vocabulary(spark, sf_dir, side), f"{side}_ids") for side in ("dx", "pr")}
    return encode_arrays(admissions(spark, sf_dir), "enc_id", sides, keep=False)


cte(
    "code_rows",
    """SELECT enc_id, year, 'dx' AS side, unnest(range(0, len(dx)))::INT AS pos, unnest(dx) AS code FROM adm
UNION ALL SELECT enc_id, year, 'pr', unnest(range(0, len(pr)))::INT, unnest(pr) FROM adm""",
    "adm",
)
cte(
    "vocab",
    f"""SELECT side, code, first_year, n,
  (3 + row_number() OVER (PARTITION BY side ORDER BY first_year, code))::INT AS id
FROM (SELECT side, code, min(year) AS first_year, count(*) AS n FROM code_rows
      WHERE year IN {sql_in(DEVELOPMENT_YEARS)} AND code <> '' GROUP BY 1, 2)""",
    "code_rows",
)
cte(
    "id_rows",
    """SELECT r.*, CASE WHEN code = '' THEN 3 ELSE coalesce(v.id, 2) END AS id
FROM code_rows r LEFT JOIN vocab v USING (side, code)""",
    "vocab",
)
cte(
    "encoded",
    """SELECT a.*, coalesce(d.ids, []::INT[]) AS dx_ids, coalesce(p.ids, []::INT[]) AS pr_ids
FROM adm a
LEFT JOIN (SELECT enc_id, list(id ORDER BY pos) AS ids FROM id_rows WHERE side = 'dx' GROUP BY 1) d USING (enc_id)
LEFT JOIN (SELECT enc_id, list(id ORDER BY pos) AS ids FROM id_rows WHERE side = 'pr' GROUP BY 1) p USING (enc_id)""",
    "id_rows",
)
