"""Rows drawn inside bins, and the cohort by another way, on tables made here."""

import duckdb
import pytest
from check_queries import compare

import __spark_entry__ as entry
from strandline.operators import ordering as O


def test_in_bin_resampling_draws_rows(spark, tmp_path):
    docs = [(i, "en", "s", i * 37 % 5000) for i in range(300)]
    labels = [(i, int(i % 3 == 0), 0) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    name = "in_bin_resampling"
    assert "draws_b" in entry.oracle_sql()[name]
    assert compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("hot", [False, True])
def test_order_number_moves_rows_once(spark, monkeypatch, hot):
    """Rows without a crowded lead are cut by it alone: no table of cells is written."""
    written, real = [], O.materialise
    monkeypatch.setattr(O, "materialise", lambda d, label: (written.append(label), real(d, label))[1])
    rows = [((7 if hot and i % 3 else i * 13 % 997), i % 5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "v int, w int, t int")
    got = {r.t: r.cum__one for r in O.running_rows(df.selectExpr("*", "1L AS _one"), [], ["v", "w"], "t", ["_one"], rows=20).collect()}
    assert got == {t: n + 1 for n, (_, _, t) in enumerate(sorted(rows))}
    assert ("cells" in written) == hot
