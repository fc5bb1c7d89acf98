"""KD queries over tables whose tree would be deeper than the 12 levels of their SQL."""

import duckdb
import numpy as np
import pytest

from lattica.catalog import ORACLE_SQL, QUERIES, learned, searches
from lattica.operators.kd_cells import kd_nodes
from lattica.operators.points import Points


@pytest.fixture(scope="module")
def deep(tmp_path_factory):
    """A folder with 6,000 parts: leaves of one point would be 13 levels down."""
    draw, folder = np.random.default_rng(3), tmp_path_factory.mktemp("deep")
    size, price = draw.integers(1, 50, 6000), np.round(draw.uniform(900, 999, 6000), 1)
    rows = ", ".join(f"({i}, {a}, {b}::DOUBLE)" for i, (a, b) in enumerate(zip(size, price, strict=True)))
    duckdb.sql(f"COPY (SELECT p_partkey::BIGINT AS p_partkey, p_size, p_retailprice FROM (VALUES {rows}) t(p_partkey, p_size, p_retailprice)) TO '{folder}/part.parquet'")
    return str(folder)


def same(spark, folder, monkeypatch, name):
    """The query and its SQL, both with leaves of one point."""
    for module in (searches, learned):
        monkeypatch.setattr(module, "LEAF", 1)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    sql = ORACLE_SQL[name].replace("> 100 THEN", "> 1 THEN")
    assert sql != ORACLE_SQL[name]
    mine = QUERIES[name](spark, folder)
    theirs = db.sql(f"SELECT {', '.join(mine.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, mine.collect())) == sorted(theirs)


def test_leaf_split(spark, deep, monkeypatch):
    same(spark, deep, monkeypatch, "kd_leaf_split")


def test_mapping(spark, deep, monkeypatch):
    same(spark, deep, monkeypatch, "kd_mapping")


def test_learned_partitions(spark, deep, monkeypatch):
    same(spark, deep, monkeypatch, "kd_learned_partitions")


@pytest.mark.parametrize("levels", [0, 2, 4, 9])
def test_levels_are_the_same_however_they_are_made(spark, deep, levels):
    """Whether the last level is reached over all tasks or in one, no point is lost and no node is deeper."""
    points = Points.of(spark.read.parquet(f"{deep}/part.parquet"), ["p_partkey"], ["p_size", "p_retailprice"])
    found = [sorted((r["p_partkey"], r["node"]) for r in kd_nodes(points, 20, rows, levels).collect()) for rows in (300, 100_000)]
    assert found[0] == found[1] and len(found[0]) == 6000
    assert max(node for _, node in found[0]).bit_length() - 1 == min(levels, 9)
    if levels == 9:
        assert found[0] == sorted((r["p_partkey"], r["node"]) for r in kd_nodes(points, 20).collect())
