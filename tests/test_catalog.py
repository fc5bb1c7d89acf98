"""Every query against DuckDB, and the driver's entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(fix, row)) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, db, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    theirs = db.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bounds_reach_the_scan(spark, sf_dir):
    """A stored box query reads two columns and pushes its ranges to Parquet."""
    from lattica.plans import search

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice").toDF("x0", "x1")
    plan = search.in_rectangle(df, (1.0, 2.0), (3.0, 4.0))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,1.0)" in plan and "l_tax" not in plan
