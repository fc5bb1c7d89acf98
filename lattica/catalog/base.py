"""Registry, tables as points, and the same points in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.points import Points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_X = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def parts(spark: SparkSession, sf_dir: str) -> Points:
    return Points.of(read(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


def lines(spark: SparkSession, sf_dir: str, d: int = 4) -> Points:
    return Points.of(read(spark, sf_dir, "lineitem"), LINE_KEY, LINE_X[:d])


def customers(spark: SparkSession, sf_dir: str) -> Points:
    return Points.of(read(spark, sf_dir, "customer"), ["c_custkey"], ["c_acctbal", "c_custkey"], keep=["c_nationkey"])


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a query among the parts; some lie outside."""
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("qid"), (F.col("s_nationkey").cast("double") * 2 + 1).alias("q0"), (F.lit(900.0) + (F.col("s_acctbal") + 1000) * F.lit(0.009)).alias("q1"))


def boxes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation as a box among the parts."""
    n = F.col("n_nationkey").cast("double")
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bid"), n.alias("lo0"), (F.lit(900.0) + n * 3).alias("lo1"), (n + 10).alias("hi0"), (F.lit(920.0) + n * 3).alias("hi1"))


P = "p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0, CAST(p_retailprice AS DOUBLE) AS x1 FROM part)"
L = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS x0, CAST(l_extendedprice AS DOUBLE) AS x1, CAST(l_discount AS DOUBLE) AS x2, CAST(l_tax AS DOUBLE) AS x3 FROM lineitem)"
C = "c AS (SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DOUBLE) AS x0, CAST(c_custkey AS DOUBLE) AS x1 FROM customer)"
Q = "q AS (SELECT s_suppkey AS qid, CAST(s_nationkey AS DOUBLE) * 2 + 1 AS q0, 900e0 + (s_acctbal + 1000) * 0.009e0 AS q1 FROM supplier)"
B = "b AS (SELECT CAST(n_nationkey AS BIGINT) AS bid, CAST(n_nationkey AS DOUBLE) AS lo0, 900e0 + CAST(n_nationkey AS DOUBLE) * 3 AS lo1, CAST(n_nationkey AS DOUBLE) + 10 AS hi0, 920e0 + CAST(n_nationkey AS DOUBLE) * 3 AS hi1 FROM nation)"
D2 = "(x0 - q0) * (x0 - q0) + (x1 - q1) * (x1 - q1)"


def number(value: float) -> str:
    """A double in SQL."""
    return f"{float(value)!r}e0"


def grid_sql(points: str, key: str, shape: Sequence[int], eps: float = 0.01) -> str:
    """CTEs: s0.. (intervals of each dimension) and g (points with i0.., cell and mapping)."""
    out = []
    for i, n in enumerate(shape):
        out.append(
            f"s{i} AS (SELECT lo, CAST(row_number() OVER (ORDER BY lo) - 1 AS BIGINT) AS j, coalesce(lead(lo) OVER (ORDER BY lo), (SELECT max(x{i}) FROM {points}) + {number(eps)}) AS hi"
            f" FROM (SELECT DISTINCT min(x{i}) AS lo FROM (SELECT x{i}, ntile({n}) OVER (ORDER BY x{i}, {key}) AS t FROM {points}) GROUP BY t))"
        )
    joins = " ".join(f"JOIN s{i} ON {points}.x{i} >= s{i}.lo AND {points}.x{i} < s{i}.hi" for i in range(len(shape)))
    cell = "s0.j"
    for i in range(1, len(shape)):
        cell = f"({cell} * (SELECT count(*) FROM s{i}) + s{i}.j)"
    own = " * ".join(f"({points}.x{i} - s{i}.lo)" for i in range(len(shape)))
    whole = " * ".join(f"(s{i}.hi - s{i}.lo)" for i in range(len(shape)))
    places = ", ".join(f"CAST(s{i}.j AS INTEGER) AS i{i}" for i in range(len(shape)))
    out.append(f"g AS (SELECT {points}.*, {places}, CAST({cell} AS BIGINT) AS cell, CAST({cell} AS DOUBLE) + ({own}) / ({whole}) AS mapping FROM {points} {joins})")
    return ", ".join(out)
