"""Geometry as column expressions: all of it stays in generated code.

A point is a list of d columns, a box two such lists, lo and hi. Boxes are closed on both ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, mul

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def vector(prefix: str, d: int, table: str = "") -> list[Column]:
    """The columns prefix0 ... of a table."""
    return [F.col(f"{table}.{prefix}{i}" if table else f"{prefix}{i}") for i in range(d)]


def constants(values: Sequence[float]) -> list[Column]:
    return [F.lit(float(v)) for v in values]


def square(x: Column) -> Column:
    return x * x


def distance_squared(p: Vector, q: Vector) -> Column:
    return reduce(add, [square(a - b) for a, b in zip(p, q, strict=True)])


def distance(p: Vector, q: Vector) -> Column:
    return F.sqrt(distance_squared(p, q))


def array_distance_squared(p: Column, q: Column) -> Column:
    """Of two array columns of one length."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: square(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda total, x: total + x)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def in_box(p: Vector, lo: Vector, hi: Vector) -> Column:
    return all_of([x.between(a, b) for x, a, b in zip(p, lo, hi, strict=True)])


def intervals_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def boxes_overlap(lo1: Vector, hi1: Vector, lo2: Vector, hi2: Vector) -> Column:
    return all_of([intervals_overlap(*x) for x in zip(lo1, hi1, lo2, hi2, strict=True)])


def box_order(hi1: Vector, lo2: Vector) -> Column:
    """1 if the first box reaches beyond the second's lower corner in every dimension, else -1. Not a total order."""
    return F.when(all_of([a > b for a, b in zip(hi1, lo2, strict=True)]), F.lit(1)).otherwise(F.lit(-1))


def min_distance_squared(p: Vector, lo: Vector, hi: Vector) -> Column:
    """To the nearest point of the box; 0 inside."""
    return reduce(add, [square(F.greatest(a - x, x - b, F.lit(0.0))) for x, a, b in zip(p, lo, hi, strict=True)])


def max_distance_squared(p: Vector, lo: Vector, hi: Vector) -> Column:
    """To the farthest corner of the box."""
    return reduce(add, [square(F.greatest(F.abs(x - a), F.abs(x - b))) for x, a, b in zip(p, lo, hi, strict=True)])


def min_max_distance_squared(p: Vector, lo: Vector, hi: Vector) -> Column:
    """The least bound within which a minimal box is sure to have a point: one side's near edge, all others' far edges."""
    low_half = [x >= (a + b) / 2 for x, a, b in zip(p, lo, hi, strict=True)]
    far = [square(x - F.when(upper, a).otherwise(b)) for x, a, b, upper in zip(p, lo, hi, low_half, strict=True)]
    near = [square(x - F.when(upper, b).otherwise(a)) for x, a, b, upper in zip(p, lo, hi, low_half, strict=True)]
    # Sums of squares alone, none taken away again: a bound must not come out too small.
    bounds = [reduce(add, [near[j] if i == j else far[j] for j in range(len(far))]) for i in range(len(far))]
    return bounds[0] if len(bounds) == 1 else F.least(*bounds)


def centre(lo: Vector, hi: Vector) -> list[Column]:
    return [(a + b) / 2 for a, b in zip(lo, hi, strict=True)]


def volume(lo: Vector, hi: Vector) -> Column:
    return reduce(mul, [b - a for a, b in zip(lo, hi, strict=True)])


def enlargement(p: Vector, lo: Vector, hi: Vector) -> Column:
    """The volume that a box gains when it grows to hold the point."""
    grown = volume([F.least(x, a) for x, a in zip(p, lo, strict=True)], [F.greatest(x, b) for x, b in zip(p, hi, strict=True)])
    return grown - volume(lo, hi)


def bounds(p: Vector, lo: str = "lo", hi: str = "hi") -> list[Column]:
    """Aggregates for the bounding box of points: lo0.., hi0.. ."""
    return [F.min(x).alias(f"{lo}{i}") for i, x in enumerate(p)] + [F.max(x).alias(f"{hi}{i}") for i, x in enumerate(p)]


def bounds_of_boxes(lo: Vector, hi: Vector) -> list[Column]:
    return [F.min(a).alias(f"lo{i}") for i, a in enumerate(lo)] + [F.max(b).alias(f"hi{i}") for i, b in enumerate(hi)]


def prefix_sums_not_negative(values: Column) -> Column:
    """Whether every sum of the first elements of an array is 0 or more."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(True).alias("good"))
    step = lambda s, x: F.struct((s["total"] + x).alias("total"), (s["good"] & (s["total"] + x >= 0)).alias("good"))
    return F.aggregate(values, start, step)["good"]


def hinges(x: Column, breaks: Column) -> Column:
    """max(0, x - b) for each break b."""
    return F.transform(breaks, lambda b: F.greatest(x - b, F.lit(0.0)))


def comparisons(x: Column, constants_: Column) -> Column:
    """Whether x is no less than each constant."""
    return F.transform(constants_, lambda c: x >= c)


def piecewise(x: Column, alpha: Column, beta: Column) -> Column:
    """alpha[0] + sum of alpha[i + 1] * (x - beta[i]) over breaks up to x."""
    slopes = F.slice(alpha, F.lit(2), F.greatest(F.size(alpha) - 1, F.lit(0)))
    terms = F.zip_with(slopes, beta, lambda a, b: F.when(x >= b, a * (x - b)).otherwise(F.lit(0.0)))
    return F.aggregate(terms, F.element_at(alpha, 1), lambda total, t: total + t)
