"""Every registered query against its SQL in another engine, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_plans_prune_and_push(spark):
    """A filter by id and few columns reach the scan; no query of these scans reads the text."""
    plan = catalogue.QUERIES["filter_lists"](spark, SF)._jdf.queryExecution().toString()
    read = [line for line in plan.splitlines() if "ReadSchema" in line and "doc_id" in line and "source" in line]
    assert read and all("n_chars" not in line for line in read)
    point = catalogue.QUERIES["keyset_page"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThan(page_id,100)" in point and "html" not in point.split("ReadSchema")[1]
