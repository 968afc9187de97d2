"""Readers and writers: each query writes a driver table in a source format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.layout import NULL_TOKENS
from strandline.plans.bindings import encounters, sql_in, table
from strandline.plans.registry import query, rnd, sql
from strandline.session import materialise, scratch_path
from strandline.sources import gzip_members as G
from strandline.sources import readers as R
from strandline.sources import writers as W



def layout(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


LONG, INT, DOUBLE, TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
CUSTOMER = layout(c_custkey=LONG, c_name=TEXT, c_nationkey=INT, c_acctbal=DOUBLE, c_mktsegment=TEXT)
SUPPLIER = layout(s_suppkey=LONG, s_name=TEXT, s_nationkey=INT, s_acctbal=DOUBLE)


@query(
    "scan_headerless_csv",
    "SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
)
def scan_headerless_csv(spark, sf_dir):
    path = scratch_path(spark, "headerless")
    blank = F.when(F.pmod("c_custkey", F.lit(5)) > 0, F.col("c_mktsegment")).otherwise("")
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", blank)
    rows.write.csv(path, header=False, quoteAll=True, emptyValue="")
    return R.read_delimited(spark, path, CUSTOMER, ["c_custkey", "c_acctbal", "c_mktsegment"])


@query("scan_single_quoted_csv", "SELECT s_suppkey, s_name || ', ltd' AS s_name, s_nationkey, s_acctbal FROM supplier")
def scan_single_quoted_csv(spark, sf_dir):
    path = scratch_path(spark, "single-quoted")
    rows = table(spark, sf_dir, "supplier").withColumn("s_name", F.concat(F.col("s_name"), F.lit(", ltd")))
    rows.write.csv(path, header=True, quote="'", quoteAll=True)
    return R.read_delimited(spark, path, SUPPLIER, header=True, quote="'")


@query(
    "scan_null_tokens",
    "SELECT c_custkey, CASE WHEN c_custkey % 12 = 11 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
)
def scan_null_tokens(spark, sf_dir):
    path = scratch_path(spark, "null-tokens")
    spelled = F.col("c_acctbal").cast("string")
    for i, token in enumerate(NULL_TOKENS):
        spelled = F.when(F.pmod("c_custkey", F.lit(12)) == i, token).otherwise(spelled)
    rows = table(spark, sf_dir, "customer").select("c_custkey", spelled.alias("c_acctbal"), "c_mktsegment")
    rows.write.csv(path, header=True)
    schema = layout(c_custkey=LONG, c_acctbal=DOUBLE, c_mktsegment=TEXT)
    return R.read_with_null_tokens(spark, path, schema)


@query(
    "scan_ragged_rows",
    """SELECT p_partkey::VARCHAR AS code, p_brand AS brand,
  p_name || CASE WHEN p_partkey % 3 = 0 THEN ', ' || p_type || ',' || p_size ELSE '' END AS description FROM part""",
)
def scan_ragged_rows(spark, sf_dir):
    path = scratch_path(spark, "ragged")
    tail = F.when(
        F.pmod("p_partkey", F.lit(3)) == 0,
        F.concat(F.lit(", "), F.col("p_type"), F.lit(","), F.col("p_size").cast("string")),
    ).otherwise("")
    line = F.concat(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", "p_name"), tail)
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return R.read_ragged(spark, path, ["code", "brand", "description"])


@query(
    "scan_gzip_csv",
    "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type FROM events",
)
def scan_gzip_csv(spark, sf_dir):
    path = scratch_path(spark, "gzip")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").write.csv(path, header=True, compression="gzip")
    return R.read_all_text(spark, path, ["event_id", "user_id", "event_type"])


@query(
    "scan_gzip_members",
    "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type FROM events",
)
def scan_gzip_members(spark, sf_dir):
    """Files of many gzip members, each file read by several tasks."""
    path = scratch_path(spark, "members")
    names = ["event_id", "user_id", "event_type"]
    lines = table(spark, sf_dir, "events").select(F.to_csv(F.struct(*names)).alias("value"))
    G.write_gzip_members(lines, path, header=",".join(names))
    record = F.from_csv("value", F.lit(", ".join(f"{c} string" for c in names)), {"mode": "FAILFAST"})
    return G.read_gzip_lines(spark, path, header=True).select(record.alias("r")).select("r.*")


RECORD = layout(
    subject=TEXT, features=layout(amount=DOUBLE, nation=INT), label=layout(leaf=TEXT, any=INT), ids=T.ArrayType(LONG)
)


def json_records(spark, sf_dir):
    """Customers as pretty-printed nested objects, then read back."""
    path = scratch_path(spark, "objects")
    record = F.struct(
        F.col("c_custkey").cast("string").alias("subject"),
        F.struct(F.col("c_acctbal").alias("amount"), F.col("c_nationkey").alias("nation")).alias("features"),
        F.struct(
            F.when(F.col("c_nationkey") % 4 > 0, F.col("c_mktsegment")).alias("leaf"),
            (F.col("c_nationkey") % 4 > 0).cast("int").alias("any"),
        ).alias("label"),
        F.sequence(F.col("c_custkey"), F.col("c_custkey") + F.pmod("c_custkey", F.lit(3))).alias("ids"),
    )
    table(spark, sf_dir, "customer").select(F.to_json(record, {"pretty": "true"}).alias("value")).write.text(path)
    return R.read_json_objects(spark, path, RECORD)


@query(
    "scan_json_objects",
    """SELECT c_custkey::VARCHAR AS subject, CASE WHEN c_nationkey % 4 > 0 THEN c_mktsegment END AS leaf FROM customer""",
)
def scan_json_objects(spark, sf_dir):
    return json_records(spark, sf_dir).select("subject", "label.leaf")


@query(
    "flatten_records",
    """SELECT c_custkey::VARCHAR AS subject, c_acctbal AS amount, c_nationkey AS nation, (c_nationkey % 4 > 0)::INT AS any_label,
  (c_custkey % 3 + 1)::INT AS id_count FROM customer""",
)
def flatten_records(spark, sf_dir):
    return json_records(spark, sf_dir).select(
        "subject",
        F.col("features.amount").alias("amount"),
        F.col("features.nation").alias("nation"),
        F.col("label.any").alias("any_label"),
        F.size("ids").alias("id_count"),
    )


@query(
    "endpoint_gate",
    """SELECT count(*) AS n_records, count(*) FILTER (WHERE c_nationkey % 4 > 0) AS kept, count(*) FILTER (WHERE c_nationkey % 4 = 0) AS dropped,
  round(avg(c_acctbal) FILTER (WHERE c_nationkey % 4 > 0), 4) AS mean_kept FROM customer""",
)
def endpoint_gate(spark, sf_dir):
    known = F.col("label.leaf").isNotNull()
    return json_records(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(known).alias("kept"),
        F.count_if(~known).alias("dropped"),
        rnd(F.avg(F.when(known, F.col("features.amount"))), 4).alias("mean_kept"),
    )


@query(
    "scan_pruned_parquet",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
)
def scan_pruned_parquet(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).select("o_orderkey", "o_totalprice")


def year_table(spark, sf_dir):
    path = scratch_path(spark, "by-year")
    W.write_table(encounters(spark, sf_dir), path, ["year"])
    return path


@query(
    "year_partitioned_table",
    sql("SELECT year, count(*) AS n, sum(stay)::BIGINT AS stay FROM enc WHERE year IN (1996, 1999) GROUP BY 1", "enc"),
)
def year_partitioned_table(spark, sf_dir):
    path = year_table(spark, sf_dir)
    rows = R.read_years(spark, path, [1996, 1999], ["year", "stay"])
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("stay").alias("stay"))


@query(
    "multi_year_union",
    sql("SELECT enc_id, year, charge FROM enc WHERE year IN (1995, 1996, 1997) AND age >= 18", "enc"),
)
def multi_year_union(spark, sf_dir):
    path = year_table(spark, sf_dir)
    adult = F.col("age") >= 18
    parts = [R.read_years(spark, path, [y], ["enc_id", "year", "charge"], adult) for y in (1995, 1996, 1997)]
    return R.union_years(*parts)


@query(
    "semi_join_scan",
    """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def semi_join_scan(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.read_related(table(spark, sf_dir, "orders"), wanted, ["o_custkey"]).select("o_orderkey")


@query("bounded_row_read", "SELECT least(count(*), 500) AS n FROM orders")
def bounded_row_read(spark, sf_dir):
    return R.read_first(table(spark, sf_dir, "orders"), 500).agg(F.count(F.lit(1)).alias("n"))


@query(
    "reference_table_load",
    "SELECT p_brand AS code, count(*) AS n, min(p_size) AS smallest FROM part GROUP BY 1",
)
def reference_table_load(spark, sf_dir):
    """A code list kept as one multi-line JSON document."""
    path = scratch_path(spark, "reference")
    codes = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.min("p_size").alias("smallest")
    )
    # a code list is a short reference table
    whole = codes.groupBy().agg(F.sort_array(F.collect_list(F.struct("code", "n", "smallest"))).alias("codes"))
    whole.select(F.to_json(F.struct("codes"), {"pretty": "true"}).alias("value")).write.text(path)
    schema = layout(codes=T.ArrayType(layout(code=TEXT, n=LONG, smallest=INT)))
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("codes"))


@query("compressed_table_write", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def compressed_table_write(spark, sf_dir):
    path = scratch_path(spark, "zstd")
    W.write_table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), path)
    return spark.read.parquet(path)


@query(
    "report_files",
    """SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean_price, 'csv' AS format FROM orders GROUP BY 1
UNION ALL SELECT o_orderstatus, count(*), round(avg(o_totalprice), 2), 'json' FROM orders GROUP BY 1""",
)
def report_files(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 2).alias("mean_price")
    )
    out = []
    schema = layout(status=TEXT, n=LONG, mean_price=DOUBLE)
    for fmt in ("csv", "json"):
        path = scratch_path(spark, f"report-{fmt}")
        W.write_report(totals, path, ["status"], fmt)
        back = R.read_delimited(spark, path, schema, header=True) if fmt == "csv" else spark.read.schema(schema).json(path)
        out.append(back.withColumn("format", F.lit(fmt)))
    return out[0].unionByName(out[1])


@query("publish_once", "SELECT o_orderkey, o_custkey, true AS refused FROM orders")
def publish_once(spark, sf_dir):
    path = scratch_path(spark, "published")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    W.publish(spark, path, lambda p: W.write_table(rows, p))
    try:
        W.publish(spark, path, lambda p: W.write_table(rows, p))
        refused = False
    except W.AlreadyPublished:
        refused = True
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


@query(
    "annual_artifacts",
    sql(
        """SELECT 'core' AS artifact, count(*) AS n FROM enc UNION ALL
SELECT 'severity', count(*) FROM enc WHERE severity IS NOT NULL UNION ALL
SELECT 'entity', count(*) FROM (SELECT DISTINCT year, entity_id FROM enc)""",
        "enc",
    ),
)
def annual_artifacts(spark, sf_dir):
    source = materialise(encounters(spark, sf_dir), "source")
    paths = W.write_artifacts(
        scratch_path(spark, "artifacts"),
        source,
        {
            "core": lambda df: df.select("enc_id", "year", "entity_id", "start_day", "stay"),
            "severity": lambda df: df.where("severity IS NOT NULL").select("enc_id", "severity", "risk"),
            "entity": lambda df: df.select("year", "entity_id").distinct(),
        },
    )
    counts = [
        spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n")
        for name, p in paths.items()
    ]
    return R.union_years(*counts)


@query(
    "locked_subset",
    sql(
        f"""SELECT enc_id, year, age, stay FROM enc WHERE year IN {sql_in((1995, 1996))} AND age >= 18 AND died = 0""",
        "enc",
    ),
)
def locked_subset(spark, sf_dir):
    """Projected development rows whose size per year must equal the expected one."""
    enc = encounters(spark, sf_dir)
    subset = materialise(enc.where("year IN (1995, 1996) AND age >= 18 AND died = 0").select("enc_id", "year", "age", "stay"), "subset")
    expected = enc.where("age >= 18 AND died = 0 AND year < 1997").groupBy("year").agg(F.count(F.lit(1)).alias("expected"))
    sizes = subset.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    wrong = sizes.join(expected, "year", "full_outer").where(~F.col("n").eqNullSafe(F.col("expected")))
    if not wrong.isEmpty():
        raise ValueError("locked subset has an unexpected size")
    return subset
