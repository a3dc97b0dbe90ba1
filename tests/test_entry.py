"""The driver's contract."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")


def test_queries_and_sql_belong_together() -> None:
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(q) for q in entry.queries().values()) and all(isinstance(s, str) for s in entry.oracle_sql().values())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the supplied tables")
@pytest.mark.parametrize("name", ["search_frontier", "kept_pages", "upsert_listings", "run_counters", "run_summary", "price_history", "new_matches", "inspect_listings", "fold_documents"])
def test_query_equals_sql(spark: SparkSession, name: str) -> None:
    import duckdb

    con = duckdb.connect()
    for table in ("orders", "events", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, str(SMALL))
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not SMALL.exists(), reason="needs the supplied tables")
def test_entry(spark: SparkSession) -> None:
    rows = entry.entry(spark)
    assert rows.columns[:3] == ["platform", "external_id", "verdict"] and rows.limit(1).count() == 1
