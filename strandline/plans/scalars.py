"""Column functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import ids, text
from strandline.functions import values as V
from strandline.layout import NULL_TOKENS
from strandline.operators import features, models
from strandline.operators.joins import checked_join
from strandline.plans.bindings import (
    admissions,
    class_scores,
    encounters,
    line_codes,
    scored_documents,
    scored_lines,
    stays,
    table,
)
from strandline.plans.registry import query, rnd, rounded, sql

RAW_CODE = "'  ' || lower(p_type) || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END"


def raw_code():
    tail = F.when(F.pmod("p_partkey", F.lit(3)) == 0, " ").otherwise("")
    return F.concat(F.lit("  "), F.lower("p_type"), F.lit("."), F.pmod("p_partkey", F.lit(10)).cast("string"), tail)


@query(
    "normalize_code",
    f"""SELECT p_partkey, upper(replace(trim({RAW_CODE}), '.', '')) AS code,
  coalesce(CASE WHEN p_partkey % 5 > 0 THEN upper(p_brand) END, '') AS brand FROM part""",
)
def normalize_code(spark, sf_dir):
    brand = F.when(F.pmod("p_partkey", F.lit(5)) > 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.normalize_code(raw_code()).alias("code"), text.normalize_code(brand).alias("brand")
    )


@query(
    "strip_quotes",
    "SELECT p_partkey, p_name AS a, p_name AS b, '' AS c FROM part",
)
def strip_quotes(spark, sf_dir):
    quoted = F.concat(F.lit(" '"), F.col("p_name"), F.lit("' "))
    double = F.concat(F.lit("'\""), F.col("p_name"), F.lit(" \"'"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.strip_quotes(quoted).alias("a"),
        text.strip_quotes(double).alias("b"),
        text.strip_quotes(F.lit(None).cast("string")).alias("c"),
    )


@query(
    "normalize_category",
    "SELECT p_partkey, p_size::VARCHAR AS whole, CASE WHEN p_partkey % 2 = 0 THEN p_size || '.5' ELSE p_type END AS other FROM part",
)
def normalize_category(spark, sf_dir):
    other = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(
        F.concat(F.lit(" "), F.col("p_type"))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.normalize_category(F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("whole"),
        text.normalize_category(other).alias("other"),
    )


@query(
    "collapse_blanks",
    r"""SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS flat,
  upper(trim(regexp_replace(source || '  ' || lang, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS place FROM documents""",
)
def collapse_blanks(spark, sf_dir):
    place = F.concat(F.lit(" "), F.col("source"), F.lit("  "), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.collapse_blanks(F.col("text")).alias("flat"), text.place_text(place).alias("place")
    )


@query(
    "active_status",
    """SELECT c_custkey, c_custkey % 4 <> 0 AS active FROM customer""",
)
def active_status(spark, sf_dir):
    status = F.when(F.pmod("c_custkey", F.lit(4)) == 0, F.concat(F.lit(" REMOVED  in "), F.col("c_mktsegment"))).otherwise(
        F.concat(F.lit("kept, not removed "), F.col("c_mktsegment"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.is_active(status).alias("active"))


# ids ----------------------------------------------------------------------------

@query(
    "opaque_ids",
    """SELECT o_orderkey, substr(sha256(year(o_orderdate) || ':' || o_custkey), 1, 32) AS entity,
  sha256(year(o_orderdate) || ':' || o_custkey) AS entity_full,
  substr(sha256(year(o_orderdate) || ':'), 1, 32) AS no_raw FROM orders""",
)
def opaque_ids(spark, sf_dir):
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        ids.opaque_id(year, F.col("o_custkey")).alias("entity"),
        ids.opaque_id_full(year, F.col("o_custkey")).alias("entity_full"),
        ids.opaque_id(year, F.lit(None).cast("string")).alias("no_raw"),
    )


@query(
    "year_scoped_ids",
    """SELECT o_orderkey, ('0x' || substr(md5(year(o_orderdate) || ':' || o_custkey), 1, 15))::BIGINT AS id,
  CASE WHEN ('0x' || substr(md5(year(o_orderdate) || ':' || o_custkey), 1, 15))::BIGINT % 2 = 0 THEN 'A' ELSE 'B' END AS half
FROM orders""",
)
def year_scoped_ids(spark, sf_dir):
    id_ = ids.year_scoped_id(F.year("o_orderdate"), F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", id_.alias("id"), ids.half_by_parity(id_, "A", "B").alias("half")
    )


# numbers ------------------------------------------------------------------------

@query(
    "numeric_coercion",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS number,
  coalesce(CASE WHEN c_custkey % 6 > 0 THEN c_nationkey END, -99) AS filled FROM customer""",
)
def numeric_coercion(spark, sf_dir):
    raw = F.when(F.pmod("c_custkey", F.lit(5)) == 0, F.col("c_mktsegment")).otherwise(F.col("c_acctbal").cast("string"))
    day = F.when(F.pmod("c_custkey", F.lit(6)) > 0, F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", text.to_number(raw).alias("number"), F.coalesce(day, F.lit(-99)).alias("filled")
    )


INDEX = {1995: 152.4, 1996: 156.9, 1997: 160.5, 1998: 163.0, 1999: 166.6, 2000: 172.2, 2001: 177.1}
BASE_INDEX = 177.1
_FACTOR = "CASE year " + " ".join(f"WHEN {y} THEN {BASE_INDEX}::DOUBLE / {v}::DOUBLE" for y, v in INDEX.items()) + " END"
HIGH_COST = 150_000.0


@query(
    "cost_labels",
    sql(
        f"""SELECT enc_id, cost, cost * {_FACTOR} AS adjusted,
  CASE WHEN cost > 0 THEN (cost * {_FACTOR} > {HIGH_COST})::INT END AS high_cost, (cost > 0) IS TRUE AS observed,
  coalesce(long_stay > 5, false)::INT AS long_stay, coalesce(died = 1, false)::INT AS death
FROM (SELECT *, CASE WHEN charge > 0 AND ratio > 0 THEN charge * ratio END AS cost,
        CASE WHEN enc_id % 13 > 0 THEN stay END AS long_stay
      FROM (SELECT *, CASE entity_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 0.0::DOUBLE ELSE 0.2::DOUBLE + (entity_id % 9) / 10.0::DOUBLE END AS ratio FROM enc))""",
        "enc",
    ),
)
def cost_labels(spark, sf_dir):
    nine = F.pmod("entity_id", F.lit(9))
    ratio = F.when(nine == 1, 0.0).when(nine > 1, 0.2 + nine / 10.0)
    enc = encounters(spark, sf_dir).withColumn("cost", V.cost_from_charge(F.col("charge"), ratio))
    enc = enc.withColumn("adjusted", V.at_base_year(F.col("cost"), F.col("year"), INDEX, BASE_INDEX))
    known_stay = F.when(F.pmod("enc_id", F.lit(13)) > 0, F.col("stay"))
    high = V.label_if_known(F.col("adjusted"), HIGH_COST)
    return enc.select(
        "enc_id",
        "cost",
        "adjusted",
        high.alias("high_cost"),
        high.isNotNull().alias("observed"),
        V.label_total(known_stay > 5).alias("long_stay"),
        V.label_total(F.col("died") == 1).alias("death"),
    )


@query(
    "follow_up_observability",
    sql(
        """SELECT enc_id, (month < 12) AS before_december,
  (dayofyear(last_day(make_date(year, month, 1))) + stay + 30 <= dayofyear(make_date(year, 12, 31))) AS fits,
  month >= 2 AS seen_30d, month >= 4 AS seen_90d, month >= 7 AS seen_180d FROM enc""",
        "enc",
    ),
)
def follow_up_observability(spark, sf_dir):
    month = F.col("month")
    return encounters(spark, sf_dir).select(
        "enc_id",
        (month < 12).alias("before_december"),
        V.window_fits_year(F.col("year"), month, F.col("stay")).alias("fits"),
        (month >= 2).alias("seen_30d"),
        (month >= 4).alias("seen_90d"),
        (month >= 7).alias("seen_180d"),
    )


@query(
    "log1p_and_category_text",
    sql(
        """SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_balance,
  CASE WHEN c_custkey % 7 < 6 THEN (c_custkey % 7)::VARCHAR ELSE '<MISSING>' END AS payer FROM customer"""
    ),
)
def log1p_and_category_text(spark, sf_dir):
    payer = F.when(F.pmod("c_custkey", F.lit(7)) < 6, F.pmod("c_custkey", F.lit(7)).cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        rnd(V.log1p_floor0(F.col("c_acctbal"))).alias("log_balance"),
        text.category_text(payer).alias("payer"),
    )


@query(
    "age_bands",
    sql(
        """SELECT enc_id, CASE WHEN a > 17 AND a <= 44 THEN '18-44' WHEN a > 44 AND a <= 64 THEN '45-64'
    WHEN a > 64 AND a <= 74 THEN '65-74' WHEN a > 74 THEN '75+' END AS closed,
  CASE WHEN a < 45 THEN '18-44' WHEN a < 65 THEN '45-64' WHEN a < 75 THEN '65-74' ELSE '75+' END AS half_open
FROM (SELECT enc_id, age + (enc_id % 4) / 4.0::DOUBLE AS a FROM enc)""",
        "enc",
    ),
)
def age_bands(spark, sf_dir):
    age = F.col("age") + F.pmod("enc_id", F.lit(4)) / 4.0
    return encounters(spark, sf_dir).select(
        "enc_id", V.age_band(age).alias("closed"), V.age_band_half_open(age).alias("half_open")
    )


@query(
    "timestamps_and_ages",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END AS ts,
  CASE WHEN o_orderkey % 11 > 0 THEN (20 + o_custkey % 60 + year(o_orderdate) - 1994)::INT END AS age_at_event,
  round(date_diff('second', o_orderdate, o_orderdate + to_hours(o_orderkey % 100)) / 86400.0::DOUBLE, 6) AS days,
  (o_orderkey % 9 - 3)::INT AS day_offset FROM orders""",
)
def timestamps_and_ages(spark, sf_dir):
    key, when = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    four = F.pmod(key, F.lit(4))
    raw = (
        F.when(four == 0, F.date_format(when, "yyyy-MM-dd"))
        .when(four == 1, F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
        .when(four == 2, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format(when, "dd/MM/yyyy"))
    )
    anchor = F.when(F.pmod(key, F.lit(11)) == 0, "unknown").otherwise((20 + F.pmod("o_custkey", F.lit(60))).cast("string"))
    age = anchor.try_cast("int") + F.year(when) - F.lit("1994").try_cast("int")
    end = F.unix_micros(when) + F.pmod(key, F.lit(100)) * 3_600_000_000
    other_day = F.date_add(when.cast("date"), (F.pmod(key, F.lit(9)) - 3).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.parse_timestamp(raw).cast("timestamp_ntz").alias("ts"),
        age.cast("int").alias("age_at_event"),
        rnd((end - F.unix_micros(when)) / 86_400e6).alias("days"),
        F.datediff(other_day, when.cast("date")).alias("day_offset"),
    )


@query(
    "transfer_places",
    sql(
        "SELECT stay_id, kind = 'purchase' AS to_transfer, kind = 'signup' AS from_transfer FROM stays", "stays"
    ),
)
def transfer_places(spark, sf_dir):
    return stays(spark, sf_dir).select(
        "stay_id",
        text.is_transfer_place(F.col("to_place")).alias("to_transfer"),
        text.is_transfer_place(F.col("from_place")).alias("from_transfer"),
    )


@query(
    "procedure_day_buckets",
    sql(
        """SELECT l_orderkey, l_linenumber, prday, count(*) AS n, any_value(CASE WHEN prday IS NULL OR prday <= -90 OR prday = -66 THEN 0 WHEN prday < 0 THEN 1
   WHEN prday > l_orderkey % 8 THEN 6 WHEN prday = 0 THEN 2 WHEN prday <= 2 THEN 3 WHEN prday <= 7 THEN 4 ELSE 5 END) AS bucket,
  any_value(prday IS NOT NULL AND prday > -90 AND prday <> -66 AND prday <= 0) AS early
FROM lines GROUP BY 1, 2, 3""",
        "lines",
    ),
)
def procedure_day_buckets(spark, sf_dir):
    day, stay = F.col("prday"), F.pmod("l_orderkey", F.lit(8)).cast("int")
    marked = line_codes(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "prday", A.timing_bucket(day, stay).alias("bucket"), A.is_early(day).alias("early")
    )
    return marked.groupBy("l_orderkey", "l_linenumber", "prday").agg(
        F.count(F.lit(1)).alias("n"), F.max("bucket").alias("bucket"), F.coalesce(F.bool_or("early"), F.lit(False)).alias("early")
    )


# scores ---------------------------------------------------------------------------

@query(
    "logit_and_platt",
    sql(
        """SELECT doc_id, round(ln(q / (1 - q)), 6) + 0.0 AS logit, round(1 / (1 + exp(-(-0.2::DOUBLE + 0.9::DOUBLE * ln(q / (1 - q))))), 6) AS calibrated
FROM (SELECT doc_id, least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM docs)""",
        "docs",
    ),
)
def logit_and_platt(spark, sf_dir):
    return scored_documents(spark, sf_dir).select(
        "doc_id", rnd(V.logit(F.col("p"))).alias("logit"), rnd(V.platt(F.col("p"), -0.2, 0.9)).alias("calibrated")
    )


@query(
    "linear_score",
    sql(
        """SELECT a.enc_id, round(1 / (1 + exp(-(coalesce(s, 0.0::DOUBLE) - 0.5::DOUBLE))), 6) AS p
FROM adm a LEFT JOIN (SELECT enc_id, sum(w) AS s FROM
    (SELECT DISTINCT enc_id, code FROM (SELECT enc_id, unnest(dx) AS code FROM adm)) u
    JOIN (SELECT DISTINCT p_type || (p_partkey % 10) AS code, (p_partkey % 10) / 10.0::DOUBLE - 0.4::DOUBLE AS w FROM part) k USING (code) GROUP BY 1) x USING (enc_id)""",
        "adm",
    ),
)
def linear_score(spark, sf_dir):
    ten = F.pmod("p_partkey", F.lit(10))
    weights = table(spark, sf_dir, "part").select(
        F.concat(F.col("p_type"), ten.cast("string")).alias("code"), (ten / 10.0 - 0.4).alias("weight")
    ).distinct()
    scored = models.linear_score(admissions(spark, sf_dir).select("enc_id", "dx"), "enc_id", "dx", weights, -0.5)
    return rounded(scored.select("enc_id", "p"))


# masks, slots, bins, tiers ----------------------------------------------------------

@query(
    "class_masks",
    sql(
        """SELECT vec_id, m AS mask, bit_count(m)::INT AS size, (m >> y) & 1 = 1 AS covered,
  CASE WHEN bit_count(m) = 1 THEN log2(m)::INT END AS single_class
FROM (SELECT *, ((s0 >= 0.25)::INT + 2 * (s1 >= 0.25)::INT + 4 * (s2 >= 0.25)::INT + 8 * (s3 >= 0.25)::INT + 16 * (s4 >= 0.25)::INT)::INT AS m FROM classes)""",
        "classes",
    ),
)
def class_masks(spark, sf_dir):
    mask = V.mask_of([F.col(f"s{k}") >= 0.25 for k in range(5)])
    rows = class_scores(spark, sf_dir).withColumn("mask", mask)
    m = F.col("mask")
    return rows.select(
        "vec_id",
        "mask",
        F.bit_count(m).cast("int").alias("size"),
        V.mask_has(m, F.col("y")).alias("covered"),
        V.mask_single(m).alias("single_class"),
    )


@query(
    "year_slots",
    sql("SELECT enc_id, CASE WHEN year <= 1998 THEN year - 1995 ELSE 4 END::INT AS slot FROM enc", "enc"),
)
def year_slots(spark, sf_dir):
    known = {1995: 0, 1996: 1, 1997: 2, 1998: 3}
    return encounters(spark, sf_dir).select("enc_id", V.year_slot(F.col("year"), known, future=4).alias("slot"))


@query(
    "numeric_and_category_bins",
    """SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN '<NONFINITE_OR_OUT_OF_RANGE>'
    WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN '[0,2500)' WHEN c_acctbal >= 2500 AND c_acctbal < 5000 THEN '[2500,5000)'
    WHEN c_acctbal >= 5000 AND c_acctbal <= 9000 THEN '[5000,9000]' ELSE '<NONFINITE_OR_OUT_OF_RANGE>' END AS balance_bin,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE '<UNSEEN_OR_OTHER>' END AS segment_bin FROM customer""",
)
def numeric_and_category_bins(spark, sf_dir):
    balance = F.when(F.pmod("c_custkey", F.lit(17)) > 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        V.bin_numeric(balance, [0.0, 2500.0, 5000.0, 9000.0]).alias("balance_bin"),
        V.bin_category(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("segment_bin"),
    )


@query(
    "event_tiers_and_ratios",
    sql(
        """SELECT facility_id, n, events, CASE WHEN events >= 100 THEN 'CONFIRMATORY_GE_100_EVENTS'
   WHEN events >= 50 THEN 'EXPLORATORY_50_TO_99_EVENTS' ELSE 'DESCRIPTIVE_LT_50_EVENTS' END AS tier,
  CASE WHEN others = 0 THEN NULL ELSE round(events::DOUBLE / others, 6) END AS odds
FROM (SELECT facility_id, line_no % 2 AS odd, count(*) AS n, sum(y_part)::BIGINT AS events, count(*) FILTER (WHERE y_any = 0 AND line_no = 7) AS others
      FROM scored GROUP BY 1, 2)""",
        "scored",
    ),
)
def event_tiers_and_ratios(spark, sf_dir):
    by = scored_lines(spark, sf_dir).groupBy("facility_id", (F.col("line_no") % 2).alias("odd")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("y_part").alias("events"),
        F.count_if((F.col("y_any") == 0) & (F.col("line_no") == 7)).alias("others"),
    )
    return by.select(
        "facility_id",
        "n",
        "events",
        V.event_tier(F.col("events")).alias("tier"),
        rnd(V.ratio(F.col("events"), F.col("others"))).alias("odds"),
    )


@query(
    "frozen_scaling",
    sql(
        """WITH src AS (SELECT enc_id, year, age::DOUBLE AS age, severity::DOUBLE AS severity, charge FROM enc),
med AS (SELECT quantile_cont(age, 0.5) AS a, quantile_cont(severity, 0.5) AS s, quantile_cont(charge, 0.5) AS c FROM src WHERE year <= 1998),
sd AS (SELECT stddev_pop(age) AS a, stddev_pop(coalesce(severity, med.s)) AS s, stddev_pop(charge) AS c FROM src, med WHERE year <= 1998)
SELECT enc_id, round((age - med.a) / sd.a, 6) + 0.0 AS age, round((coalesce(severity, med.s) - med.s) / sd.s, 6) + 0.0 AS severity,
  (severity IS NULL)::INT::DOUBLE AS severity_missing, round((charge - med.c) / sd.c, 6) + 0.0 AS charge FROM src, med, sd""",
        "enc",
    ),
)
def frozen_scaling(spark, sf_dir):
    enc = encounters(spark, sf_dir)
    state = features.fit_numeric(enc.where(F.col("year") <= 1998), ["age", "severity", "charge"])
    scaled = {name: features.scaled(s) for name, s in state.items()}
    return rounded(
        enc.select(
            "enc_id",
            *[value.alias(name) for name, (value, _) in scaled.items()],
            scaled["severity"][1].alias("severity_missing"),
        )
    )


@query(
    "frozen_one_hot",
    sql(
        """WITH lv AS (SELECT list(payer::VARCHAR ORDER BY payer::VARCHAR) AS levels FROM
   (SELECT DISTINCT payer FROM enc WHERE year <= 1998 AND payer IS NOT NULL AND payer < 4))
SELECT enc_id, list_transform(levels || ['__MISSING__', '__OOV__'], lambda l: (l = v)::INT::DOUBLE) AS hot
FROM (SELECT enc_id, levels, CASE WHEN payer IS NULL THEN '__MISSING__' WHEN list_contains(levels, payer::VARCHAR) THEN payer::VARCHAR
   ELSE '__OOV__' END AS v FROM enc, lv)""",
        "enc",
    ),
)
def frozen_one_hot(spark, sf_dir):
    enc = encounters(spark, sf_dir)
    known = enc.where((F.col("year") <= 1998) & (F.col("payer") < 4))
    levels = features.fit_levels(known, ["payer"])
    return enc.select("enc_id", features.one_hot("payer", levels["payer"]).alias("hot"))


@query(
    "outcome_packaging",
    sql(
        """SELECT e.enc_id, e.year AS context_year, e.female AS context_female, (e.died = 1)::INT AS outcome_death,
  (e.stay > 5)::INT AS outcome_long_stay FROM enc e""",
        "enc",
    ),
)
def outcome_packaging(spark, sf_dir):
    enc = encounters(spark, sf_dir)
    context = enc.select("enc_id", "year", "female").withColumnsRenamed({"year": "context_year", "female": "context_female"})
    outcomes = enc.select(
        "enc_id",
        V.label_total(F.col("died") == 1).alias("outcome_death"),
        V.label_total(F.col("stay") > 5).alias("outcome_long_stay"),
    )
    return checked_join(context, outcomes, ["enc_id"])


@query(
    "decode_null_tokens",
    "SELECT c_custkey, CASE WHEN c_custkey % 12 = 11 THEN c_mktsegment END AS segment FROM customer",
)
def decode_null_tokens(spark, sf_dir):
    spelled = F.col("c_mktsegment")
    for i, token in enumerate(NULL_TOKENS):
        spelled = F.when(F.pmod("c_custkey", F.lit(12)) == i, token).otherwise(spelled)
    return table(spark, sf_dir, "customer").select("c_custkey", text.decode_nulls(spelled).alias("segment"))
