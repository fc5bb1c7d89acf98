"""Equi-depth grids: borders, cells, the one-dimensional mapping, and boxes cut at the borders."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.geometry import all_of, bounds
from lattica.operators.points import Points
from lattica.operators.ranking import values_at


def step_of(x: Column, starts: Sequence[float]) -> Column:
    """The last start that is not over x (the first, if all are), by halving: as deep as the logarithm of their number."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(x >= F.lit(starts[middle]), among(middle, high)).otherwise(among(low, middle - 1))

    return among(0, len(starts) - 1)


@dataclass(frozen=True)
class Grid:
    """starts: for each dimension the ascending, distinct lower borders; ends: the upper border of the last interval."""

    starts: tuple[tuple[float, ...], ...]
    ends: tuple[float, ...]

    @classmethod
    def fit(cls, points: Points, shape: Sequence[int], border_eps: float = 0.01) -> Grid:
        """Borders at the smallest values of equal chunks; the last interval ends border_eps above the largest value.

        Borders that coincide count once. Each dimension is counted by value and ranked over range partitions.
        """
        starts, ends = [], []
        for i, chunks in enumerate(shape):
            found, most = values_at(points.df, f"x{i}", chunks)
            if most is None:
                found, most = [0.0], 0.0
            starts.append(tuple(sorted(set(found))))
            ends.append(most + border_eps)
        return cls(tuple(starts), tuple(ends))

    @property
    def d(self) -> int:
        return len(self.starts)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(s) for s in self.starts)

    @property
    def n_cells(self) -> int:
        return reduce(mul, self.shape)

    def edges(self, dim: int) -> tuple[float, ...]:
        return (*self.starts[dim], self.ends[dim])

    def interval(self, dim: int, x: Column) -> Column:
        """The number of the interval that holds x; outer values belong to the first or last."""
        return step_of(x, self.starts[dim])

    def low(self, dim: int, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.edges(dim)]), at + 1)

    def high(self, dim: int, at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.edges(dim)]), at + 2)

    def cell_of(self, intervals: Sequence[Column]) -> Column:
        """Row-major number of a cell, the last dimension running fastest."""
        return reduce(lambda cell, x: cell * F.lit(x[0]) + x[1], zip(self.shape[1:], intervals[1:], strict=True), intervals[0].cast("long"))

    def fraction(self, p: Sequence[Column], intervals: Sequence[Column]) -> Column:
        """The share of the cell's volume between its lower corner and the point."""
        parts = [x - self.low(i, at) for i, (x, at) in enumerate(zip(p, intervals, strict=True))]
        sizes = [self.high(i, at) - self.low(i, at) for i, at in enumerate(intervals)]
        return F.coalesce(F.try_divide(reduce(mul, parts), reduce(mul, sizes)), F.lit(0.0))

    def place(self, points: Points) -> DataFrame:
        """The points with i0.., cell and mapping (cell + fraction)."""
        df = points.df.select("*", *[self.interval(i, x).alias(f"i{i}") for i, x in enumerate(points.x)])
        at = [F.col(f"i{i}") for i in range(self.d)]
        df = df.withColumn("cell", self.cell_of(at))
        return df.withColumn("mapping", F.col("cell") + self.fraction(points.x, at))

    def mapping_in_cell(self, cell: Column, lower: Sequence[Column], p: Sequence[Column]) -> Column:
        """A given cell's number plus the fraction of the point p within the cell of the point lower."""
        return cell + self.fraction(p, [self.interval(i, x) for i, x in enumerate(lower)])

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells: cell, i0.., lo0.., hi0.. . Made by the executors from the cell's number."""
        df = spark.range(self.n_cells).withColumnRenamed("id", "cell")
        rest, intervals = F.col("cell"), []
        for n in reversed(self.shape):
            intervals.append((rest % n).cast("int"))
            rest = F.floor(rest / n)
        intervals.reverse()
        df = df.select("cell", *[x.alias(f"i{i}") for i, x in enumerate(intervals)])
        at = [F.col(f"i{i}") for i in range(self.d)]
        return df.select("*", *[self.low(i, x).alias(f"lo{i}") for i, x in enumerate(at)], *[self.high(i, x).alias(f"hi{i}") for i, x in enumerate(at)])

    def occupied(self, placed: DataFrame) -> DataFrame:
        """cell, bounding box and number of its points, of cells that have any."""
        return placed.groupBy("cell").agg(*bounds([F.col(f"x{i}") for i in range(self.d)]), F.count(F.lit(1)).alias("n"))

    def frames(self, cells: DataFrame) -> DataFrame:
        """cells with flo0.., fhi0..: the borders of each cell, from its number."""
        rest, intervals = F.col("cell"), []
        for n in reversed(self.shape):
            intervals.append((rest % n).cast("int"))
            rest = F.floor(rest / n)
        at = intervals[::-1]
        return cells.select("*", *[self.low(i, x).alias(f"flo{i}") for i, x in enumerate(at)], *[self.high(i, x).alias(f"fhi{i}") for i, x in enumerate(at)])

    def cells_of(self, boxes: DataFrame) -> DataFrame:
        """boxes (lo0.., hi0.., more) with a row for each cell that a box can have points in; none for an empty box."""
        full = all_of([F.col(f"lo{i}") <= F.col(f"hi{i}") for i in range(self.d)])
        df = boxes.where(full)
        for i in range(self.d):
            steps = F.sequence(self.interval(i, F.col(f"lo{i}")), self.interval(i, F.col(f"hi{i}")))
            df = df.withColumn(f"_i{i}", F.explode(steps))
        at = [F.col(f"_i{i}") for i in range(self.d)]
        return df.withColumn("cell", self.cell_of(at)).drop(*[f"_i{i}" for i in range(self.d)])

    def cuts(self, dim: int, lo: float, hi: float) -> list[tuple[float, float]]:
        """An interval cut at the borders within it; its lower side is held to the first border."""
        start = max(lo, self.starts[dim][0])
        if hi < start:
            return []
        inner = [b for b in self.edges(dim) if lo < b < hi and b > start]
        ends = [start, *inner, hi]
        return list(itertools.pairwise(ends)) if hi > start or len(ends) == 2 else []

    def decompose(self, lo: Sequence[float], hi: Sequence[float]) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
        """A box as the boxes that the borders cut it into; none, if it lies below the grid."""
        pieces = [self.cuts(i, a, b) for i, (a, b) in enumerate(zip(lo, hi, strict=True))]
        return [(tuple(a for a, _ in piece), tuple(b for _, b in piece)) for piece in itertools.product(*pieces)]

    def steps(self, lo: Sequence[float], hi: Sequence[float]) -> list[range]:
        """For each dimension the intervals that a box meets; outer intervals have no outer end."""
        found = []
        for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
            starts = self.starts[i]
            first = max(0, sum(s <= a for s in starts) - 1)
            last = max(0, sum(s <= b for s in starts) - 1)
            found.append(range(first, last + 1) if b >= a else range(0))
        return found

    def meets(self, lo: Sequence[float], hi: Sequence[float], listed: int = 1000) -> Column:
        """Condition on cell and i0.. for the cells that a box meets: the cells by number if few, else the intervals of each dimension."""
        steps = self.steps(lo, hi)
        n = reduce(mul, map(len, steps))
        if not n:
            return F.lit(False)
        number = lambda at: reduce(lambda cell, x: cell * x[0] + x[1], zip(self.shape[1:], at[1:], strict=True), at[0])
        if n <= listed:
            return F.col("cell").isin([number(at) for at in itertools.product(*steps)])
        ends = F.col("cell").between(number([s[0] for s in steps]), number([s[-1] for s in steps]))
        return all_of([ends, *(F.col(f"i{i}").between(s[0], s[-1]) for i, s in enumerate(steps))])
