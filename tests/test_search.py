"""Indexed answers equal full scans."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators.box_tree import BoxTree, parent_chains, rebalance, split_until, two_means
from lattica.operators.grid import Grid
from lattica.operators.kd_cells import kd_cells, kd_nodes, order_violations, split_level
from lattica.operators.layout import LearnedIndex
from lattica.operators.points import Points
from lattica.plans import search
from lattica.sources.store import load_index, load_tree, save_index, save_tree


def cloud(spark, n, d, seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.uniform(0, 20, (n, d)))  # many points are alike
    rows = [(i, *map(float, p)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "pid long, " + ", ".join(f"x{i} double" for i in range(d)))
    return Points.of(df, ["pid"], [f"x{i}" for i in range(d)]), x


def brute(x, q, k):
    d2 = ((x - np.array(q)) ** 2).sum(1)
    return [(int(i), float(d2[i])) for i in np.lexsort((np.arange(len(x)), d2))[:k]]


QUERIES = [(3.0, 4.0), (-10.0, 50.0), (20.0, 20.0), (7.5, 0.1)]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, *q) for i, q in enumerate(QUERIES)], "qid long, q0 double, q1 double")


def answers(df):
    out = {}
    for r in df.orderBy("qid", "rn").collect():
        out.setdefault(r["qid"], []).append((r["pid"], r["d2"]))
    return [out.get(i, []) for i in range(len(QUERIES))]


@pytest.mark.parametrize(("n", "k"), [(400, 7), (30, 50), (1, 1)])
def test_nearest_neighbours(spark, asked, n, k):
    points, x = cloud(spark, n, 2, n)
    expected = [brute(x, q, k) for q in QUERIES]
    assert answers(search.batch_nearest(points, asked, k)) == expected
    grid = Grid.fit(points, (5, 4))
    placed = grid.place(points)
    assert answers(search.indexed_nearest(points.with_df(placed), grid.occupied(placed), asked, k)) == expected
    df, cells = kd_cells(kd_nodes(points, 25), 2)
    assert answers(search.indexed_nearest(points.with_df(df), cells, asked, k)) == expected
    assert answers(BoxTree.build(points, 10).nearest(asked, k)) == expected
    single = [(r["pid"], r["d2"]) for r in search.nearest(points, QUERIES[0], k).orderBy("rn").collect()]
    ball = [(r["pid"], r["d2"]) for r in search.expanding_radius(points, QUERIES[0], k, 0.5).orderBy("rn").collect()]
    assert single == ball == expected[0]


def test_candidates_are_few(spark, asked):
    points, _ = cloud(spark, 400, 2, 5)
    grid = Grid.fit(points, (10, 10))
    cells = grid.occupied(grid.place(points))
    assert search.candidate_cells(cells, asked, 3, 2).count() < 0.5 * cells.count() * len(QUERIES)


def test_boxes(spark):
    points, x = cloud(spark, 300, 3, 9)
    tree = BoxTree.build(points, 12)
    for lo, hi in [((0, 0, 0), (20, 20, 20)), ((5, 5, 5), (9, 12, 6)), ((5, 5, 5), (5, 5, 5)), ((30, 30, 30), (40, 40, 40))]:
        expected = {int(i) for i in np.flatnonzero(((x >= lo) & (x <= hi)).all(1))}
        assert {r["pid"] for r in search.in_rectangle(points.df, lo, hi).collect()} == expected
        assert {r["pid"] for r in tree.search(lo, hi).collect()} == expected
        assert tree.visited(lo, hi).count() <= tree.nodes.count()


def test_radius_and_lookup(spark):
    points, x = cloud(spark, 200, 2, 4)
    assert {r["pid"] for r in search.within(points.df, (10.0, 10.0), 5.0).collect()} == {int(i) for i in np.flatnonzero(((x - 10) ** 2).sum(1) <= 25)}
    tree = BoxTree.build(points, 10)
    for i in (0, 57):
        same = {int(j) for j in np.flatnonzero((x == x[i]).all(1))}
        assert {r["pid"] for r in tree.find(tuple(x[i])).collect()} == same
        assert {r["pid"] for r in search.at_point(points.df, tuple(x[i])).collect()} == same


def check_tree(tree, n):
    nodes = {r["node"]: r for r in tree.nodes.collect()}
    roots = [r for r in nodes.values() if r["parent"] is None]
    assert len(roots) == 1 and roots[0]["n"] == n
    leaves = {}
    for r in tree.points.df.collect():
        leaves.setdefault(r["node"], []).append(r)
    for name, rows in leaves.items():
        leaf = nodes[name]
        assert leaf["is_leaf"] and leaf["n"] == len(rows) <= tree.capacity
        assert all(leaf["lo0"] <= r["x0"] <= leaf["hi0"] for r in rows)
    for r in nodes.values():
        if r["parent"] is not None:
            up = nodes[r["parent"]]
            assert up["level"] == r["level"] + 1 and up["lo0"] <= r["lo0"] and up["hi1"] >= r["hi1"]


def test_tree_structure_and_insert(spark):
    points, x = cloud(spark, 500, 2, 2)
    tree = BoxTree.build(points.with_df(points.df.where("pid < 300")), 10)
    check_tree(tree, 300)
    grown = tree.insert(points.with_df(points.df.where("pid >= 300")))
    check_tree(grown, 500)
    asked = spark.createDataFrame([(0, 3.0, 4.0)], "qid long, q0 double, q1 double")
    assert [(r["pid"], r["d2"]) for r in grown.nearest(asked, 9).orderBy("rn").collect()] == brute(x, (3.0, 4.0), 9)
    small = BoxTree.build(points, 10, task_rows=100)  # large groups are split by distributed rounds
    check_tree(small, 500)
    chains = parent_chains(small.nodes)
    assert chains.where("distance = 0").count() == small.nodes.count()


def test_splits():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(100, 3))
    side = two_means(x, 25)
    assert min(np.bincount(side)) >= 25
    assert np.bincount(two_means(np.zeros((80, 2)), 25)).tolist() == [40, 40]
    assert sorted(np.bincount(rebalance(np.array([0] * 9 + [1]), np.arange(10.0)[:, None], np.array([[0.0], [9.0]]), 3)).tolist()) == [3, 7]
    paths = split_until(x, 10)
    assert max(paths.count(p) for p in set(paths)) <= 10


def test_kd_leaves(spark):
    points, _ = cloud(spark, 333, 2, 6)
    nodes = kd_nodes(points, 20)
    sizes = [r["count"] for r in nodes.groupBy("node").count().collect()]
    assert sum(sizes) == 333 and max(sizes) <= 20
    df, cells = kd_cells(nodes, 2)
    assert df.where(F.floor("mapping") != F.col("cell")).count() == 0
    assert order_violations(cells, 2).count() == 0


def test_order_violations(spark):
    """A numbering at random against all pairs; numbers with gaps, sides that touch, and a numbering in order."""
    draw = np.random.default_rng(5)
    lo = draw.integers(0, 60, size=(700, 2)).astype(float)
    hi = lo + draw.integers(0, 3, size=(700, 2))
    number = np.sort(draw.choice(5000, 700, replace=False))
    rows = [(int(c), *map(float, a), *map(float, b)) for c, a, b in zip(number, lo, hi, strict=True)]
    schema = "cell int, lo0 double, lo1 double, hi0 double, hi1 double"
    found = order_violations(spark.createDataFrame(rows, schema), 2)
    assert found.dtypes == [("later", "int"), ("earlier", "int")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # the few runs at the top
    later, earlier = np.nonzero((lo[:, None] < hi[None, :]).all(2) & (number[:, None] > number[None, :]))
    assert sorted(map(tuple, found.collect())) == sorted(zip(number[later].tolist(), number[earlier].tolist(), strict=True))
    strip = spark.createDataFrame([(i, float(i), 0.0, float(i + 1), 1.0) for i in range(2000)], schema)
    assert order_violations(strip, 2).count() == 0
    assert order_violations(strip.where("cell < 0"), 2).count() == 0


def test_empty(spark, asked):
    points, _ = cloud(spark, 3, 2, 1)
    none = points.with_df(points.df.where("pid < 0"))
    assert search.batch_nearest(none, asked, 3).count() == 0
    grid = Grid.fit(none, (3, 3))
    placed = grid.place(none)
    assert search.indexed_nearest(none.with_df(placed), grid.occupied(placed), asked, 3).count() == 0
    assert BoxTree.build(none).search((0, 0), (9, 9)).count() == 0


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 1.0)], "pid long, a double, b double")
    assert Points.of(df, ["pid"], ["a", "b"]).df.count() == 1 and Points.dropped(df, ["a", "b"]) == 2
    arrays = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "pid long, v array<double>")
    assert Points.of_arrays(arrays, ["pid"], "v", 2).df.count() == 1


def test_store(spark, tmp_path, asked):
    points, x = cloud(spark, 200, 2, 8)
    save_index(LearnedIndex.build(points, (4, 4), parts=4, breaks=3), f"{tmp_path}/grid")
    index = load_index(spark, f"{tmp_path}/grid")
    expected = [brute(x, q, 5) for q in QUERIES]
    assert answers(search.indexed_nearest(points.with_df(index.points), index.cells, asked, 5)) == expected
    box = index.points.where(index.grid.meets((2, 2), (6, 6)))
    assert search.in_rectangle(box, (2, 2), (6, 6)).count() == search.in_rectangle(points.df, (2, 2), (6, 6)).count()
    save_tree(BoxTree.build(points, 20), f"{tmp_path}/tree")
    assert answers(load_tree(spark, f"{tmp_path}/tree").nearest(asked, 5)) == expected


@pytest.mark.parametrize("exact", [1, 40, 1000])
def test_kd_halves_are_exact_at_every_size(spark, exact):
    """Many ties in x0, few in x1: the rows of a node are halved as the SQL halves them, however they are ranked."""
    rows = [(i * 7919 % 301, float(i % 5), float(i * i % 83)) for i in range(301)]
    df = spark.createDataFrame(rows, "pid long, x0 double, x1 double").withColumn("node", F.lit(1).cast("long"))
    expected = "SELECT pid, x0, x1, 1 AS node FROM t"
    for level in range(4):
        df = split_level(df, f"x{level % 2}", ("pid",), 25, exact)
        expected = f"SELECT pid, x0, x1, CASE WHEN n > 25 THEN 2 * node + r ELSE node END AS node FROM (SELECT *, count(*) OVER (PARTITION BY node) AS n, ntile(2) OVER (PARTITION BY node ORDER BY x{level % 2}, pid) - 1 AS r FROM ({expected}))"
    db = duckdb.connect()
    db.execute("CREATE TABLE t (pid BIGINT, x0 DOUBLE, x1 DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    assert sorted(map(tuple, df.select("pid", "node").collect())) == sorted(db.sql(f"SELECT pid, node FROM ({expected})").fetchall())


def test_kd_points_all_alike_are_halved(spark, monkeypatch):
    monkeypatch.setattr(split_level, "__defaults__", (20,))
    points = Points(spark.range(101).selectExpr("id AS pid", "1D AS x0", "1D AS x1"), ("pid",), 2)
    sizes = [r["count"] for r in kd_nodes(points, 10).groupBy("node").count().collect()]
    assert sum(sizes) == 101 and max(sizes) <= 10
