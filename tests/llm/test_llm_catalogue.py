"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from mnemora.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sf001, name):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf001):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf001}/{f}')")
    want = c.execute(catalogue.ORACLES[name]).df()
    got = entry.queries()[name](spark, sf001).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    keys = [x for x in columns if x != "sent_at"]  # the two write time zones differently
    rows = [sorted(map(repr, df[keys].astype(str).itertuples(index=False, name=None))) for df in (got, want)]
    assert rows[0] == rows[1]
