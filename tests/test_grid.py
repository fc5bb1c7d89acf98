"""Grids: borders, cells, mapping and decomposition."""

import itertools

import pytest
from pyspark.sql import functions as F

from lattica.operators.grid import Grid
from lattica.operators.layout import LearnedIndex, cell_shards, page, partition_bounds, partitioned
from lattica.operators.points import Points
from lattica.operators.ranking import equal_parts, global_rank, values_at
from lattica.operators.rank_model import fit, rises


def lattice(spark, side, d):
    rows = [(n, *map(float, p)) for n, p in enumerate(itertools.product(range(side), repeat=d))]
    df = spark.createDataFrame(rows, "pid long, " + ", ".join(f"x{i} double" for i in range(d)))
    return Points.of(df, ["pid"], [f"x{i}" for i in range(d)])


@pytest.fixture(scope="module")
def plane(spark):
    return lattice(spark, 6, 2)


def cells_at(spark, grid, points):
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(points)], "pid long, " + ", ".join(f"x{i} double" for i in range(grid.d)))
    placed = grid.place(Points.of(df, ["pid"], [f"x{i}" for i in range(grid.d)]))
    return [tuple(r) for r in placed.orderBy("pid").select("cell", "mapping").collect()]


@pytest.mark.parametrize(("shape", "borders"), [((3, 3), (0, 2, 4)), ((2, 2), (0, 3))])
def test_borders(plane, shape, borders):
    grid = Grid.fit(plane, shape, border_eps=0.0)
    assert grid.starts == (borders, borders) and grid.ends == (5, 5)
    assert Grid.fit(plane, shape).ends == (5.01, 5.01)


def test_axis_borders(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert values_at(df, "v", 3) == ([0, 4, 7], 9)
    assert values_at(df.where("v < 0"), "v", 3) == ([], None)
    assert values_at(df, "v", 20)[0] == [float(i) for i in range(10)]


def test_cells_and_mapping(spark, plane):
    grid = Grid.fit(plane, (3, 3), border_eps=0.0)
    found = cells_at(spark, grid, [(3, 4), (0, 0), (5, 0), (5, 2), (0.4, 0.3), (3.5, 1.2)])
    assert [c for c, _ in found] == [5, 0, 6, 7, 0, 3]
    assert found[4][1] == pytest.approx(0.03) and found[5][1] == pytest.approx(3.45)


def test_repeated_borders_lose_no_points(spark):
    df = spark.createDataFrame([(i, float(min(i % 7, 2)), 1.0) for i in range(100)], "pid long, x0 double, x1 double")
    p = Points.of(df, ["pid"], ["x0", "x1"])
    grid = Grid.fit(p, (10, 4))
    placed = grid.place(p)
    assert len(set(grid.starts[0])) == len(grid.starts[0]) and placed.count() == 100
    assert placed.where(F.floor("mapping") != F.col("cell")).count() == 0


@pytest.mark.parametrize(("lo", "hi", "n"), [((0.5, 0.5), (1.5, 1.5), 1), ((0.5, 0.5), (2.5, 1.5), 2), ((1, 1), (3, 5), 6), ((0, 0), (5, 5), 9), ((-9, -9), (-5, -5), 0), ((-1, -1), (6, 6), 9)])
def test_decompose(plane, lo, hi, n):
    pieces = Grid.fit(plane, (3, 3), border_eps=0.0).decompose(lo, hi)
    if (lo, hi) != ((-1, -1), (6, 6)):
        assert len(pieces) == n
    area = sum((b[0] - a[0]) * (b[1] - a[1]) for a, b in pieces)
    assert area == pytest.approx(max(0, hi[0] - max(0, lo[0])) * max(0, hi[1] - max(0, lo[1])))


def test_cells_of_boxes(spark, plane):
    grid = Grid.fit(plane, (3, 3))
    assert grid.cells(spark).count() == 9
    placed = grid.place(plane)
    for lo, hi in [((1, 1), (3, 5)), ((-5, -5), (0, 0)), ((5, 5), (99, 99)), ((2, 2), (2, 2)), ((3, 3), (1, 1))]:
        box = (F.col("x0").between(lo[0], hi[0])) & (F.col("x1").between(lo[1], hi[1]))
        for listed in (1000, 0):
            assert placed.where(grid.meets(lo, hi, listed) & box).count() == placed.where(box).count()


def test_global_rank_and_parts(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), (F.col("id") % 3).alias("w"))
    ranked = equal_parts(global_rank(df, ["v"]), 7)
    assert ranked.where("rank <> v").count() == 0
    assert sorted(r["count"] for r in ranked.groupBy("part").count().collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert equal_parts(global_rank(df.limit(3), ["v"]), 7).select("part").distinct().count() == 3


def test_learned_index(spark, plane):
    index = LearnedIndex.build(plane, (3, 3), parts=3, breaks=2, psi=5)
    rows = index.points.collect()
    assert len(rows) == 36 and len({r["pid"] for r in rows}) == 36
    assert {r["part"] for r in rows} == {0, 1, 2}
    assert all(r["m_lo"] <= r["m_hi"] and r["n"] == 12 for r in partition_bounds(index.points).collect())
    assert max(r["n"] for r in index.points.groupBy("part", "shard", "page").agg(F.count("*").alias("n")).collect()) <= 5
    one = rows[0]
    assert one["pid"] in {r["pid"] for r in page(index.points, one["part"], one["shard"], one["page"]).collect()}
    assert cell_shards(index.points).count() >= 9


def test_model_is_no_worse_than_its_start():
    import numpy as np

    x = np.sort(np.random.default_rng(3).gamma(2.0, 3.0, 500))
    alpha, beta, loss, first = fit(x, 5)
    assert loss <= first + 1e-9 and len(alpha) == 6 and (np.diff(beta) >= 0).all() and rises(alpha)
    alpha, *_ = fit(np.zeros(10), 3)
    assert np.isfinite(alpha).all()


def test_parts_of_ranked(spark, plane):
    ranked = partitioned(Grid.fit(plane, (3, 3)).place(plane), plane.key, 4)
    assert [r["n"] for r in partition_bounds(ranked).orderBy("part").collect()] == [9, 9, 9, 9]
    assert ranked.groupBy("part").agg(F.min("rank"), F.max("rank")).where("`min(rank)` <> 0 or `max(rank)` <> 8").count() == 0
