"""Steps that many queries share move no more than they need; on tables made here."""

import datetime

import duckdb
import pytest
from check_queries import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandline.operators import codes as C
from strandline.operators import history as H
from strandline.operators import linkage as L
from strandline.operators.history import id_spans
from strandline.operators.joins import JoinContractError, checked_join
from strandline.plans import bindings, linkage, modelling


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("orders")
    kinds = ["ECONOMY ANODIZED", "PROMO TIN", "STANDARD BRASS", "LARGE STEEL", "SMALL"]
    part = [(i, kinds[i % 5].split()[0], f"Brand#{i % 9 + 1}") for i in range(50)]
    day = datetime.datetime(1997, 1, 1)
    orders = [(i, i % 23 + 3, "F", 10.0 + i, day + datetime.timedelta(days=i * 17 % 700), ["1-URGENT", "5-LOW", "3-MEDIUM"][i % 3]) for i in range(900)]
    lines = [(i, (i * 7 + k) % 50, (i + k) % 11, k, 1.0, 2.0, 0.01, 0.0, "R", "F", day) for i in range(900) for k in range(i % 4)]
    shapes = {
        "part": (part, "p_partkey long, p_type string, p_brand string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in shapes.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["cohort_rebuild", "cohort_reconciliation", "episodes", "encoded_arrays"])
def test_twins_on_own_rows(spark, folder, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert compare(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ["minimum_derivative", "checked_history_join", "history_code_bags"])
def test_history_twins_on_own_rows(spark, folder, name, monkeypatch):
    """With the ways for crowded entities and large vocabularies shut, which these rows do not need."""
    shut = lambda *args, **kw: pytest.fail("rows were moved by position")
    monkeypatch.setattr(C, "encode_rows", shut)
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert compare(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


def test_no_cell_is_copied_to_thirty_days(spark, folder):
    plan = linkage.rebuild(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "sequence(" not in plan


def test_code_arrays_stay_where_they_are(spark, folder):
    assert not {"dx", "pr", "prday"} & set(linkage.episodes(spark, folder).columns)
    assert not {"dx", "pr"} & set(bindings.encoded(spark, folder).columns)


def test_arrays_without_their_codes(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, [], ["z", ""]), (3, [], ["a"])], "k int, x array<string>, y array<string>")
    ids = spark.createDataFrame([("A", 4), ("B", 5)], "code string, id int")
    columns = {"x": (ids, "x_ids"), "y": (ids, "y_ids")}
    kept, slim = (C.encode_arrays(rows, "k", columns, keep=keep) for keep in (True, False))
    assert slim.columns == ["k", "x_ids", "y_ids"] and set(kept.columns) == {"k", "x", "y", "x_ids", "y_ids"}
    found = {r.k: (r.x_ids, r.y_ids) for r in slim.collect()}
    assert found[1] == ([4, 5], [5]) and found[2][0] == [] and found[3] == ([], [4])
    assert found == {r.k: (r.x_ids, r.y_ids) for r in kept.collect()}


def test_spans_move_once(spark):
    rows = spark.createDataFrame([(2000, 1, 5, 2, [4, 4, 9]), (2000, 1, 5, 2, [9]), (2000, 1, 90, 1, [4])], "year int, entity_id int, start_day int, stay int, ids array<int>")
    spans = id_spans(rows, ["ids"])
    assert spans._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.id, r["first"], r["last"]) for r in spans.collect()) == [(4, 14, 181), (4, 182, 542), (9, 14, 374)]


def test_growing_tables_are_not_broadcast(spark, folder):
    """Every join of the published cohort, whose small files become large tables in memory."""
    adm = bindings.admissions(spark, folder)
    rule = linkage.L.development_rule("principal_1", "age", "died", "disposition")
    plan = linkage.L.build_episodes(adm.drop("dx", "pr"), F.col("any_1"), rule)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_arrays_are_encoded_where_they_are(spark):
    rows = spark.createDataFrame([(k, ["a.", None, "zz", "b"][k % 3:], None if k % 5 == 0 else ["", "B"]) for k in range(300)], "k int, x array<string>, y array<string>").coalesce(1)
    ids = spark.createDataFrame([("A", 4), ("B", 5)], "code string, id int")
    columns = {"x": (ids, "x_ids"), "y": (ids, "y_ids")}
    there, moved = C.encode_arrays(rows, "k", columns), C.encode_arrays(rows, "k", columns, rows=1)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(there) == 0 < exchanges(moved)
    assert sorted(there.collect(), key=lambda r: r.k) == sorted(moved.select(*there.columns).collect(), key=lambda r: r.k)
    twice = C.encode_arrays(rows.unionAll(rows), "k", columns)
    assert exchanges(twice) > 0


def test_only_stays_an_index_can_see_are_taken_apart(spark):
    shape = "year int, entity_id int, start_day int, stay int, ids array<int>"
    rows = spark.createDataFrame(
        [(2000, 1, d, s, [10 + i, 10 + i % 3]) for i, (d, s) in enumerate([(5, 2), (60, 0), (100, 3), (240, 1), (300, 0), (360, 2)])]
        + [(2000, 2, 9, 0, [99]), (2000, None, 9, 0, [98]), (2000, 1, None, 0, [97])], shape
    )
    index = rows.where("start_day IN (100, 300) AND entity_id = 1")
    at = index.withColumn("axis", (2 * F.col("start_day")).cast("long"))
    seen = H.seen_stays(rows, index)
    assert sorted(r.start_day for r in seen.collect()) == [5, 60, 100, 240]
    crowd = rows.groupBy("year", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(seen.collect()) == sorted(H.seen_stays(rows, index, crowd).collect())
    bags = lambda stays: {r.axis: r.bag_ids for r in H.id_bags(at, id_spans(stays, ["ids"]), ["ids"]).collect()}
    assert bags(seen) == bags(rows) and len(bags(rows)) == 2


def _moves(df):
    """Places at which the final plan moves rows, and the keys by which it does."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_frames_move_cells_once(spark):
    cells = spark.createDataFrame([(1, 5, 2), (1, 9, 3), (1, None, 7), (None, 5, 11), (2, 5, 13), (3, 1, 17)], "e int, d int, n int")
    asked = spark.createDataFrame([(1, 9), (1, 4), (1, None), (None, 5), (3, 40), (4, 5)], "e int, d int")
    frames = {"ahead": (1, 5), "near": (-3, 0)}
    found = L.range_summary(cells, asked, ["e"], "d", frames, {"a": ("ahead", F.sum("n")), "b": ("near", F.sum("n"))})
    assert sorted(found.where("d IS NOT NULL AND e IS NOT NULL").collect()) == [(1, 4, 5, None), (1, 9, None, 3), (3, 40, None, None), (4, 5, None, None)]
    # the distinct points by their axis, then points and cells by their part
    assert len(_moves(found)) == 2


def test_wide_rows_move_once_for_both_answers(spark, folder):
    adm = bindings.admissions(spark, folder).withColumn("cause", F.col("cause_code"))
    cells = L.day_cells(adm).localCheckpoint()
    out = L.with_next_gap(L.with_follow_up(adm, cells, crowd=False), cells, crowd=False)
    by_entity = [m for m in _moves(out) if m.count("#") == 2]
    assert len(by_entity) == 3  # the rows, their follow-up and the next starts
    plain = L.with_next_gap(L.with_follow_up(adm, cells, crowd=True), cells, crowd=True)
    names = ["enc_id", "next_start", "next_gap", "first_unplanned_day", "follow_up_key", "first_unknown_day", "planned_follow_ups", "unknown_follow_ups"]
    assert sorted(map(str, out.select(names).collect())) == sorted(map(str, plain.select(names).collect()))
    assert out.where("next_gap IS NOT NULL").count() and out.where("follow_up_key IS NOT NULL").count()


def test_answers_of_missing_keys_and_days_are_none(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (None, 5, "c"), (1, 6, "d"), (1, 5, "e"), (2, 5, "f")], "e int, d int, k string")
    answers = spark.createDataFrame([(1, 5, 50, None), (1, 6, None, None), (1, None, 1, 1), (None, 5, 2, 2), (2, 5, None, 8)], "e int, d int, x int, y int")
    out = L._attach(rows, answers, ["e", "d"], False)
    assert out.columns == ["e", "d", "k", "x", "y"]
    assert sorted(tuple(r)[2:] for r in out.collect()) == [("a", 50, None), ("b", None, None), ("c", None, None), ("d", None, None), ("e", 50, None), ("f", None, 8)]


def test_spans_of_dealt_rows_stay_where_they_are(spark):
    rows = spark.createDataFrame([(1, 1, d, d % 2, [4 + d % 3, 9]) for d in range(0, 900, 30)] + [(2, 1, 5, 0, [4, 4])], "year int, entity_id int, start_day int, stay int, ids array<int>")
    dealt = rows.repartition("year", "entity_id")
    found = id_spans(dealt, ["ids"], dealt=True)
    # only where they were dealt above
    assert len(_moves(found)) == 1 and sorted(found.collect()) == sorted(id_spans(rows, ["ids"]).collect())


def test_a_vocabulary_reads_its_rows_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([("A1", 1995), ("B1", 1996), ("A1", 1996), ("", 1995)], "code string, year int").coalesce(1)
    counted = F.udf(lambda c: (reads.add(1), c)[1], "string").asNondeterministic()
    found = C.fit_vocabulary(rows.withColumn("code", counted("code")), "year", [1995, 1996])
    assert sorted(found.collect()) == [("A1", 1995, 2, 4), ("B1", 1996, 1, 5)] and reads.value == 4


def test_a_checked_join_moves_partners_only(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None)], "k int, ok boolean")
    found = checked_join(left, right, ["k"], within=F.col("ok"))
    assert sorted(r.k for r in found.collect()) == [1, 2]
    with pytest.raises(JoinContractError, match="repeats"):
        checked_join(left, right.unionByName(right.where("k = 3")), ["k"], within=F.col("ok"))
    with pytest.raises(JoinContractError, match="no partner"):
        checked_join(left.unionByName(right.where("k = 3").select("k")), right, ["k"], within=F.col("ok"))


def test_model_rows_equal_those_joined_to_all_codes(spark, folder):
    rows = modelling.model_rows(spark, folder)
    codes = bindings.encoded(spark, folder).select("enc_id", "dx_ids", "pr_ids")
    index = linkage.episodes(spark, folder).where("eligible").select("enc_id")
    assert rows.count() and sorted(map(str, rows.select("enc_id", "dx_ids", "pr_ids").collect())) == sorted(map(str, index.join(codes, "enc_id").collect()))
