"""Registered queries: oracle pairing, and a sample against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from tidewatch.plans import load_all
from tidewatch.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ("metric_row", "calibrate_threshold", "switching_metrics", "cleaning_report", "sample_returns", "subperiod_table", "two_group_loss", "live_monitor_stream")


def test_every_query_has_an_oracle():
    """All but the training-data queries, some of which SQL cannot express."""
    load_all()
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    a, ac = check.rows(df.columns, df.collect())
    b, bc = check.rows(cols, cur.fetchall())
    assert ac == bc and a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
