"""Nearest neighbours through the shards of a learned index, where queries and points come in large groups."""

import numpy as np
import pytest

from lattica.operators.layout import LearnedIndex
from lattica.operators.points import Points
from lattica.plans import search
from lattica.sources import shared


@pytest.fixture(scope="module")
def crowded(spark):
    """4,000 points of 400 places in four cells, and 300 queries; one without a coordinate."""
    draw = np.random.default_rng(21)
    x = np.tile(np.round(draw.uniform(0, 40, (400, 2))), (10, 1))
    q = np.round(draw.uniform(-5, 45, (300, 2)), 1)
    points = Points.of(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "pid long, x0 double, x1 double"), ["pid"], ["x0", "x1"])
    index = LearnedIndex.build(points, (2, 2), parts=2, psi=50, model=([0.0, 30.0], [0.0]))
    return index, x, q, spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)] + [(300, None, 7.0)], "qid long, q0 double, q1 double")


def test_pairs_are_no_rows(spark, crowded):
    """Of each query no more than k rows of a group of points leave a task."""
    index, _, _, asked = crowded
    found = index.nearest(asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("pieces", [False, True])
def test_nearest(crowded, monkeypatch, pieces):
    """The same whether or not groups of points and of queries are cut."""
    index, x, q, asked = crowded
    if pieces:
        monkeypatch.setattr(search, "QUERY_BLOCK", 20)
        monkeypatch.setattr(search, "split_sides", lambda *a: shared.split_sides(*a) if len(a) > 5 else shared.split_sides(*a, 60))
    found = {}
    for r in index.nearest(asked, 5).orderBy("qid", "rn").collect():
        found.setdefault(r["qid"], []).append((r["pid"], r["d2"]))
    for i, p in enumerate(q):
        d2 = (x[:, 0] - p[0]) ** 2 + (x[:, 1] - p[1]) ** 2
        assert found[i] == [(int(j), float(d2[j])) for j in np.lexsort((np.arange(len(x)), d2))[:5]]
    assert found[300] == [(j, None) for j in range(5)]
