"""Every registered query against its SQL, and the shape of its plan."""

import os
import re

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

from __spark_entry__ import entry
from gridlens.plans.queries import ORACLE, QUERIES
from tools.check_oracle import TABLES, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# Plan nodes that would take rows out of the JVM or pair rows without a key.
FORBIDDEN = re.compile(
    r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups|CartesianProduct|BroadcastNestedLoopJoin"
)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.fixture
def stored_plans(monkeypatch):
    """Plans of the tables that a query stores on its way."""
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kw):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return plans


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name, stored_plans):
    df = QUERIES[name](spark, SF_DIR)
    for stored in stored_plans:
        assert not FORBIDDEN.search(stored), stored
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.search(plan), plan
    for line in re.findall(r"(?m)^.*\bWindow \[.*$", plan):
        window = line.strip()
        summary = re.search(r"\[_(slice|chunk)#\d+L? ASC NULLS FIRST\]$", window)
        ordered = re.search(r"\], \[[^\]]+\], \[[^\]]+\]$", window)
        unordered = re.search(r"\], \[(?:(?!ASC|DESC)[^\]])+\]$", window)
        assert summary or ordered or unordered, f"window without partition keys: {window[-400:]}"
    ours, theirs = df.toPandas(), db.execute(ORACLE[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_flagship(spark):
    assert entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["high_water_mark"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
