"""Learned indexes: boxes and nearest neighbours through model, shards and pages equal full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators.grid import Grid
from lattica.operators.kd_cells import kd_nodes
from lattica.operators.layout import LearnedIndex
from lattica.operators.points import Points
from lattica.operators.rank_model import Ranks, first_breaks, fit, not_negative, rises
from lattica.plans import search
from lattica.plans.descend import hierarchy, met_nodes, near_nodes
from lattica.sources import shared
from lattica.sources.shared import salted_join, split_join
from lattica.sources.store import load_index, read_images, read_points, save_index, write_points


def cloud(spark, n, d, seed, hot=0.3):
    """Many points are alike: a share of them lies in one place."""
    draw = np.random.default_rng(seed)
    x = np.round(draw.gamma(2.0, 6.0, (n, d)))
    x[draw.random(n) < hot] = 7.0
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, " + ", ".join(f"x{i} double" for i in range(d)))
    return Points.of(df, ["pid"], [f"x{i}" for i in range(d)]), x


def brute(x, q, k):
    d2 = ((x - np.array(q)) ** 2).sum(1)
    return [(int(i), float(d2[i])) for i in np.lexsort((np.arange(len(x)), d2))[:k]]


#: A model that falls between its second and third break.
FALLING = ([0.0, 9.0, -14.0, 6.0], [0.0, 4.0, 11.0])
BUILDS = {
    "grid": lambda p: LearnedIndex.build(p, (4, 3, 3)[: p.d], parts=3, breaks=3, psi=9),
    "kd": lambda p: LearnedIndex.build_kd(p, 12, parts=4, breaks=3, psi=7),
    "falling": lambda p: LearnedIndex.build(p, (5, 3, 2)[: p.d], parts=2, psi=5, model=FALLING),
}


@pytest.fixture(scope="module", params=[(n, d, kind) for n, d in ((300, 2), (260, 3)) for kind in BUILDS], ids=str)
def built(request, spark):
    n, d, kind = request.param
    points, x = cloud(spark, n, d, n)
    return BUILDS[kind](points), points, x


def boxes_for(x, seed):
    draw, d = np.random.default_rng(seed), x.shape[1]
    found = [(np.full(d, -50.0), np.full(d, 90.0)), (np.full(d, -9.0), np.full(d, -5.0)), (np.full(d, 500.0), np.full(d, 600.0)), (x[0], x[0]), (np.full(d, 7.0), np.full(d, 7.0)), (np.full(d, 9.0), np.full(d, 3.0))]
    for _ in range(12):
        a, b = x[draw.integers(len(x))], x[draw.integers(len(x))]
        found.append((np.minimum(a, b) - draw.integers(0, 2), np.maximum(a, b)))
    return found


def test_boxes(spark, built):
    index, _, x = built
    boxes, d = boxes_for(x, 5), x.shape[1]
    df = spark.createDataFrame([(i, *map(float, lo), *map(float, hi)) for i, (lo, hi) in enumerate(boxes)], "bid int, " + ", ".join(f"{c}{i} double" for c in ("lo", "hi") for i in range(d)))
    expected = sorted((i, int(p)) for i, (lo, hi) in enumerate(boxes) for p in np.flatnonzero(((x >= lo) & (x <= hi)).all(1)))
    for fans in (None, (2, 3)):
        assert sorted((r["bid"], r["pid"]) for r in index.boxes(df, fans).collect()) == expected
    costs = {r["bid"]: r for r in index.box_costs(df).collect()}
    for i, _ in enumerate(boxes):
        n = sum(b == i for b, _ in expected)
        assert n == (costs[i]["n_rows"] if i in costs else 0)
        assert i not in costs or (costs[i]["fetched"] >= n and 1 <= costs[i]["pages"] <= costs[i]["fetched"])
    for i in (0, 3, 4, 8, 9):
        assert sorted(r["pid"] for r in index.box(*boxes[i]).collect()) == [p for b, p in expected if b == i]


@pytest.mark.parametrize("k", [1, 6, 400])
def test_nearest(spark, built, k):
    index, _, x = built
    d = x.shape[1]
    asked = [tuple(map(float, x[3])), (7.0,) * d, (-40.0,) * d, (7.4,) * d, (300.0,) * d]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(asked)], "qid long, " + ", ".join(f"q{i} double" for i in range(d)))
    found = {}
    for r in index.nearest(df, k, (3,)).orderBy("qid", "rn").collect():
        found.setdefault(r["qid"], []).append((r["pid"], r["d2"]))
    assert [found[i] for i in range(len(asked))] == [brute(x, q, k) for q in asked]
    costs = index.nearest_costs(df, k).collect()
    assert len(costs) == len(asked) and all(r["tested"] >= min(k, len(x)) and r["pages"] >= 1 for r in costs)
    if k == 1:
        assert min(r["tested"] for r in costs) < 0.7 * len(x)


def test_layout(built):
    index, points, x = built
    rows = index.points.collect()
    assert sorted(r["pid"] for r in rows) == list(range(len(x)))
    assert all(index.psi >= n for n in (r["n"] for r in index.points.groupBy("part", "shard", "page").agg(F.count("*").alias("n")).collect()))
    one = rows[0]
    held = {r["pid"] for r in rows if (r["part"], r["shard"]) == (one["part"], one["shard"])}
    assert {r["pid"] for r in index.shard(one["part"], one["shard"]).collect()} == held
    assert sum(r["n"] for r in index.shard_boxes(one["part"], one["shard"]).collect()) == len(held)
    assert index.shards(one["part"]).where(F.col("shard") == one["shard"]).first()["n"] == len(held)
    assert index.shard(99, 0).count() == 0


@pytest.mark.parametrize("kind", ["grid", "kd"])
def test_stored(spark, tmp_path, kind):
    points, x = cloud(spark, 300, 2, 8)
    save_index(BUILDS[kind](points), f"{tmp_path}/index", groups=6)
    index = load_index(spark, f"{tmp_path}/index")
    lo, hi = (3.0, 4.0), (6.0, 9.0)
    found = index.box(lo, hi)
    assert sorted(r["pid"] for r in found.collect()) == [int(i) for i in np.flatnonzero(((x >= lo) & (x <= hi)).all(1))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cell_group" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert 0 < index.points.where(index.meets(lo, hi)).select("cell_group").distinct().count() < 6
    for listed in (1000, 0):
        box = F.col("x0").between(3, 6) & F.col("x1").between(4, 9)
        assert index.points.where(index.meets(lo, hi, listed) & box).count() == index.points.where(box).count()
    asked = spark.createDataFrame([(0, 3.0, 4.0)], "qid long, q0 double, q1 double")
    assert [(r["pid"], r["d2"]) for r in index.nearest(asked, 5).orderBy("rn").collect()] == brute(x, (3.0, 4.0), 5)


def test_empty_points(spark):
    points, _ = cloud(spark, 20, 2, 1)
    none = points.with_df(points.df.where("pid < 0"))
    index = LearnedIndex.build(none, (2, 2), model=FALLING)
    assert index.box((0, 0), (9, 9)).count() == 0
    assert index.nearest(spark.createDataFrame([(0, 1.0, 1.0)], "qid long, q0 double, q1 double"), 3).count() == 0


def test_parts_follow_the_number_of_points(spark, monkeypatch):
    from lattica.operators import layout

    monkeypatch.setattr(layout, "PART_ROWS", 20)
    points, _ = cloud(spark, 300, 2, 2)
    assert LearnedIndex.build(points, (3, 3), breaks=2).parts.count() == 15


@pytest.mark.parametrize("seed", range(4))
def test_sums_give_the_same_model(seed):
    draw = np.random.default_rng(seed)
    x = np.sort(np.round(draw.gamma(2.0, 30.0, 400), seed % 3))
    ranks, beta = Ranks(x), np.sort(draw.choice(x, 5)) - draw.random(5)
    alpha, loss = ranks.solve(ranks.share(beta))
    a = np.column_stack([np.ones(len(x)), np.maximum(0.0, x[:, None] - beta[None, :])])
    y = np.arange(len(x))
    best = np.linalg.lstsq(a, y, rcond=None)[0]
    assert loss == pytest.approx(((a @ best - y) ** 2).sum(), rel=1e-6, abs=1e-3)
    np.testing.assert_allclose(a @ ranks.slopes(alpha), a @ best, atol=1e-3)
    b, eps = ranks.share(beta), 1e-6
    error = lambda b: float(((alpha[0] + np.maximum(0, ranks.t[:, None] - b[None, :]) @ alpha[1:] - y) ** 2).sum())
    slope = np.array([(error(b + eps * e) - error(b - eps * e)) / (2 * eps) for e in np.eye(5)])
    p = np.searchsorted(ranks.t, b)
    q = np.maximum(p[:, None], p[None, :])
    curvature = (2 * alpha[1:, None] * alpha[None, 1:] * ranks.n[q]).astype(float)
    if np.linalg.matrix_rank(curvature) == 5:
        np.testing.assert_allclose(curvature @ ranks.step(b, alpha), -slope, rtol=1e-3, atol=1e-2 * np.abs(slope).max())


@pytest.mark.parametrize("seed", range(6))
def test_models_rise(seed):
    draw = np.random.default_rng(seed)
    x = np.sort(np.concatenate([draw.normal(0, 1, 200), draw.normal(50, 0.01, 200), np.full(seed * 30, 20.0)]))
    alpha, beta, loss, first = fit(x, 7)
    assert rises(alpha) and loss <= first + 1e-6
    at = np.linspace(x[0] - 1, x[-1] + 1, 500)
    f = alpha[0] + np.maximum(0, at[:, None] - beta[None, :]) @ alpha[1:]
    assert (np.diff(f) >= -1e-6 * len(x)).all()
    ranks = Ranks(x)
    rising, least = ranks.solve_rising(ranks.share(first_breaks(x, 7))), ranks.solve(ranks.share(first_breaks(x, 7)))
    assert rises(rising[0]) and rising[1] >= least[1] - 1e-3 * (1 + least[1])


def test_not_negative():
    draw = np.random.default_rng(1)
    for _ in range(30):
        a, y = draw.normal(size=(30, 5)), draw.normal(size=30)
        x = not_negative(a.T @ a, a.T @ y)
        pull = a.T @ (y - a @ x)
        assert (x[1:] >= 0).all() and (pull[1:] <= 1e-6).all() and abs(pull[x != 0]).max(initial=0) < 1e-6


def test_kd_nodes_of_points_that_are_alike(spark):
    from lattica.operators import kd_cells

    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(300)], "pid long, x0 double, x1 double")
    points = Points.of(df, ["pid"], ["x0", "x1"])
    before = kd_cells.EXACT
    try:
        kd_cells.EXACT = 50
        for task_rows in (10, 70, 1000):
            sizes = [r["count"] for r in kd_nodes(points, 20, task_rows).groupBy("node").count().collect()]
            assert sum(sizes) == 300 and max(sizes) <= 20
    finally:
        kd_cells.EXACT = before


def test_kd_nodes_are_the_same_however_they_are_made(spark):
    points, _ = cloud(spark, 500, 2, 6)
    found = [sorted((r["pid"], r["node"]) for r in kd_nodes(points, 30, task_rows).collect()) for task_rows in (1, 100, 10_000)]
    assert found[0] == found[1] == found[2]


def test_joins_of_hot_keys(spark):
    points = spark.range(1000).select((F.col("id") % 2 * (F.col("id") % 20)).alias("cell"), F.col("id").alias("pid"))
    asked = spark.createDataFrame([(c, q) for c in range(0, 20, 3) for q in range(4)], "cell long, qid long")
    sizes = points.groupBy("cell").agg(F.count("*").alias("n"))
    plain = sorted(map(tuple, points.join(asked, ["cell"]).select("cell", "pid", "qid").collect()))
    for rows in (10, 100, 5000):
        assert sorted(map(tuple, split_join(points, asked, ["cell"], sizes, ["pid"], rows).select("cell", "pid", "qid").collect())) == plain
    for limit in (1, 1000):
        assert sorted(map(tuple, salted_join(points, asked, ["cell"], ["pid"], 3, limit).select("cell", "pid", "qid").collect())) == plain


def test_many_queries_make_no_product(spark):
    """Neither cells nor points are joined with all queries; only the few boxes at the top are."""
    points, _ = cloud(spark, 3000, 2, 4, hot=0.0)
    grid = Grid.fit(points, (30, 30))
    placed = grid.place(points)
    cells = grid.occupied(placed)
    many = spark.range(200_000).select(F.col("id").alias("qid"), (F.col("id") % 97).cast("double").alias("q0"), (F.col("id") % 89).cast("double").alias("q1"))
    levels = hierarchy(cells, 2)
    assert len(levels) == 2 and levels[0].count() <= 256
    plan = search.indexed_nearest(points.with_df(placed), cells, many, 5, levels=levels)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 2  # in the first and the final plan
    boxes = many.select(F.col("qid").alias("bid"), F.col("q0").alias("lo0"), F.col("q1").alias("lo1"), (F.col("q0") + 0.5).alias("hi0"), (F.col("q1") + 0.5).alias("hi1"))
    plan = search.batch_boxes(points, boxes)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    some = boxes.where("bid < 300")
    pairs = lambda df: sorted((r["bid"], r["pid"]) for r in df.collect())
    assert pairs(search.batch_boxes(points, some, limit=10)) == pairs(search.batch_boxes(points, some))
    asked = many.where("qid < 300")
    nearest = lambda df: sorted((r["qid"], r["rn"], r["pid"], r["d2"]) for r in df.collect())
    assert nearest(search.batch_nearest(points, asked, 4, block=70)) == nearest(search.indexed_nearest(points.with_df(placed), cells, asked, 4))
    assert search.batch_nearest(points, many.where("qid < 0"), 4).count() == 0


def test_descents_keep_what_matters(spark):
    points, x = cloud(spark, 800, 2, 9, hot=0.0)
    grid = Grid.fit(points, (12, 12))
    placed = grid.place(points)
    cells = grid.occupied(placed)
    asked = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x[:20] + 0.3)], "qid long, q0 double, q1 double")
    near = {(r["qid"], r["node"]) for r in near_nodes(asked, hierarchy(cells, 2, fans=(3, 4)), 4, 2).collect()}
    cell = {r["pid"]: r["cell"] for r in placed.collect()}
    assert all((i, cell[p]) in near for i in range(20) for p, _ in brute(x, x[i] + 0.3, 4))
    assert len(near) < 20 * cells.count() / 4
    boxes = spark.createDataFrame([(0, 3.0, 3.0, 9.0, 9.0)], "bid int, lo0 double, lo1 double, hi0 double, hi1 double")
    met = {r["node"] for r in met_nodes(boxes, hierarchy(cells, 2, fans=(3, 4)), 2).collect()}
    assert met == {r["node"] for r in met_nodes(boxes, hierarchy(cells, 2, fans=()), 2).collect()}
    assert met >= {cell[int(p)] for p in np.flatnonzero(((x >= 3) & (x <= 9)).all(1))}


def test_images(spark, tmp_path):
    draw = np.random.default_rng(2)
    images = draw.integers(0, 256, (7, 1 + 3072), dtype=np.uint8)
    (tmp_path / "batch_1").write_bytes(images[:4].tobytes())
    (tmp_path / "batch_2").write_bytes(images[4:].tobytes())
    found = {(r["label"], tuple(r["image"])) for r in read_images(spark, f"{tmp_path}/batch_*").collect()}
    assert found == {(int(i[0]), tuple(map(int, i[1:]))) for i in images}


@pytest.mark.parametrize("name", ["points.csv", "points.json", "points"])
def test_written_points(spark, tmp_path, name):
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, 1.5, 3.25)], "pid long, x0 double, x1 double")
    write_points(df, f"{tmp_path}/{name}")
    assert sorted(map(tuple, read_points(spark, f"{tmp_path}/{name}").select("pid", "x0", "x1").collect())) == sorted(map(tuple, df.collect()))


def test_no_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            class _sc:  # noqa: N801
                class _dir:  # noqa: N801
                    isDefined = staticmethod(lambda: False)  # noqa: N815

                getCheckpointDir = classmethod(lambda cls: cls._dir)  # noqa: N815

            sc = classmethod(lambda cls: cls._sc)

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
    path = shared.new_path(spark, "kept")
    made = shared.stash(spark.range(3), "swept")
    assert made.count() == 3 and path
    shared.sweep(spark)
    assert not shared._written


def test_first_radius(spark):
    points, _ = cloud(spark, 20, 2, 1)
    with pytest.raises(ValueError):
        search.expanding_radius(points, (0.0, 0.0), 3, 0.0)


def test_boxes_compared(spark):
    boxes = spark.createDataFrame([(i, 10.0 * i, 10.0 * i, 10.0 * i + 9, 10.0 * i + 9) for i in (4, 1, 3, 0, 2)], "bid int, lo0 double, lo1 double, hi0 double, hi1 double")
    assert [(r["bid"], r["place"]) for r in search.in_box_order(boxes, 2).orderBy("place").collect()] == [(i, i) for i in range(5)]
