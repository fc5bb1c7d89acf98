"""Kernels against literal values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import geometry as G


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("v")).first()["v"]


C = G.constants


@pytest.mark.parametrize(("p", "q", "expected"), [((0, 0), (3, 4), 25), ((1, 2, 3), (1, 2, 3), 0), ((0, 0, 0), (1, 2, 2), 9), ((2, 0), (0, 0), 4)])
def test_distances(value, p, q, expected):
    assert value(G.distance_squared(C(p), C(q))) == expected
    assert value(G.distance(C(p), C(q))) == expected**0.5
    assert value(G.array_distance_squared(F.array(*C(p)), F.array(*C(q)))) == expected


@pytest.mark.parametrize(("p", "inside"), [((10, 20), True), ((30, 40), True), ((20, 30), True), ((9.99, 30), False), ((20, 40.01), False)])
def test_box_is_closed(value, p, inside):
    assert value(G.in_box(C(p), C((10, 20)), C((30, 40)))) is inside


@pytest.mark.parametrize(("a", "b", "meets"), [((0, 5), (5, 9), True), ((0, 5), (6, 9), False), ((0, 9), (3, 4), True), ((3, 4), (0, 9), True)])
def test_intervals(value, a, b, meets):
    assert value(G.intervals_overlap(*C(a), *C(b))) is meets


def test_boxes_meet_in_all_dimensions(value):
    assert value(G.boxes_overlap(C((0, 0)), C((5, 5)), C((5, 5)), C((9, 9))))
    assert not value(G.boxes_overlap(C((0, 0)), C((5, 5)), C((4, 6)), C((9, 9))))


@pytest.mark.parametrize(("p", "expected"), [((0, 0), 500), ((11, 50), 100), ((11, 0), 400), ((20, 30), 0), ((50, 30), 400), ((0, 30), 100)])
def test_min_distance(value, p, expected):
    assert value(G.min_distance_squared(C(p), C((10, 20)), C((30, 40)))) == expected


@pytest.mark.parametrize(("p", "expected"), [((0, 0), 1300), ((25, 35), 250)])
def test_min_max_distance(value, p, expected):
    assert value(G.min_max_distance_squared(C(p), C((10, 20)), C((30, 40)))) == expected


def test_bounds_hold_some_point(spark, value):
    """MINDIST <= nearest point <= MINMAXDIST, for minimal boxes of random points."""
    draw = np.random.default_rng(1)
    for _ in range(5):
        x, q = draw.uniform(0, 10, (6, 3)), draw.uniform(-5, 15, 3)
        near = ((x - q) ** 2).sum(1).min()
        lo, hi = C(x.min(0)), C(x.max(0))
        assert value(G.min_distance_squared(C(q), lo, hi)) <= near + 1e-9
        assert value(G.min_max_distance_squared(C(q), lo, hi)) >= near - 1e-9
        assert value(G.max_distance_squared(C(q), lo, hi)) >= ((x - q) ** 2).sum(1).max() - 1e-9


def test_bounding_boxes(spark):
    df = spark.createDataFrame([(1.0, 20.0, 3.0), (50.0, 0.0, 100.0), (7.0, 7.0, 7.0)], "x0 double, x1 double, x2 double")
    assert tuple(df.agg(*G.bounds(G.vector("x", 3))).first()) == (1, 0, 3, 50, 20, 100)


def test_enlargement_and_centre(value):
    assert value(G.enlargement(C((15, 15)), C((0, 0)), C((10, 10)))) == 125
    assert value(G.enlargement(C((5, 5)), C((0, 0)), C((10, 10)))) == 0
    assert [value(c) for c in G.centre(C((0, 10)), C((10, 30)))] == [5, 20]


def test_piecewise_and_prefix_sums(value):
    f = lambda x: value(G.piecewise(F.lit(float(x)), F.array(*C((1, 2, -1))), F.array(*C((0, 5)))))
    assert [f(-1), f(0), f(5), f(7)] == [1, 1, 11, 13]
    assert value(G.prefix_sums_not_negative(F.array(*C((1, -1, 0)))))
    assert not value(G.prefix_sums_not_negative(F.array(*C((1, -2, 5)))))
    assert value(G.hinges(F.lit(4.0), F.array(*C((1, 4, 6))))) == [3, 0, 0]
