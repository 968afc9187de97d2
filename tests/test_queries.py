"""Every registered query against its SQL twin, or at least for rows."""

import os

import duckdb
import pytest
from check_queries import TABLES, compare

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


# selection jobs need more rows than the smallest tables hold, and there the
# strata have one facility each, so resampling has no spread
LARGER_DIR = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.01")
NEEDS_MORE_ROWS = {"max_t_intervals", "elastic_net_grid", "boosted_trees_grid", "frozen_batch_scoring", "calibrator_choice", "leafwise_first_tree", "leafwise_boosted_trees"}


@pytest.fixture(scope="module")
def con():
    made = {}

    def connect(folder):
        if folder not in made:
            made[folder] = duckdb.connect()
            for t in TABLES:
                made[folder].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        return made[folder]

    return connect


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    folder = LARGER_DIR if name in NEEDS_MORE_ROWS else SF_DIR
    df = entry.queries()[name](spark, folder)
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert df.count() > 0
    else:
        assert compare(df, con(folder), twin) is None


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 3
