"""Registered queries: SQL where there is some, and a row for every document."""

import duckdb
import pytest

from gridlens.llm.queries import ORACLE, QUERIES
from tools.check_oracle import rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for view in ("documents", "pages"):
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF_DIR}/{view}.parquet'")
    ours, theirs = QUERIES[name](spark, SF_DIR).toPandas(), db.execute(ORACLE[name]).fetchdf()
    assert rows_of(ours) == rows_of(theirs)


# The conversion has a row per page, the audit one per pair or term.
OTHER_ROWS = {"op11_warc", "op13_divergence"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - OTHER_ROWS))
def test_every_document_has_a_row(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF_DIR).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())


NATIVE = ("op5_quality_rules", "op8_line_dedup", "op9_secret_scans")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
