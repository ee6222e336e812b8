"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from edgeframe import mixed_queries, queries

FOLDER = "/root/testdata/sf0.001"
#: Those that other tests don't come near.
NAMES = ("mixed_fmt", "mixed_summary", "mixed_event_changed", "mixed_search_nine_pattern", "mixed_search_wide_hex", "search_segment_multi", "search_event_ties", "summary_window", "asof_multi", "vcd_records", "list_json", "search_labels")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    both = queries.queries() | mixed_queries.queries(), queries.oracle_sql() | mixed_queries.oracle_sql()
    got = both[0][name](spark, FOLDER)
    found = con.execute(both[1][name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in got.select(columns).collect())
