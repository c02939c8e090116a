"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from leafspark.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(v) for v in row]) for row in frame.select(*columns).collect())
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(row[i]) for i in at]) for row in found.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_a_filter_reaches_the_scan(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 5").select("doc_id")
    plan = docs._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in plan and "text" not in plan.split("ReadSchema")[-1]
