"""Point sets: a DataFrame with a key and flat DOUBLE coordinates x0, x1, ... ."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import all_of, bounds, vector


@dataclass(frozen=True)
class Points:
    """df has the key columns and x0 ... x{d-1}. Points may repeat; the key tells them apart and settles ties."""

    df: DataFrame
    key: tuple[str, ...]
    d: int

    @classmethod
    def of(cls, df: DataFrame, key: Sequence[str], coordinates: Sequence[Column | str], keep: Sequence[str] = ()) -> Points:
        """Casts coordinates to DOUBLE and leaves out rows in which one is null or NaN."""
        columns = [(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"x{i}") for i, c in enumerate(coordinates)]
        flat = df.select(*key, *columns, *keep)
        whole = all_of([x.isNotNull() & ~F.isnan(x) for x in vector("x", len(columns))])
        return cls(flat.where(whole), tuple(key), len(columns))

    @classmethod
    def of_arrays(cls, df: DataFrame, key: Sequence[str], array: str, d: int) -> Points:
        """From an array column of d or more numbers."""
        return cls.of(df, key, [F.get(F.col(array), i) for i in range(d)])

    @staticmethod
    def dropped(df: DataFrame, coordinates: Sequence[str]) -> int:
        """How many rows of() leaves out."""
        columns = [F.col(c).cast("double") for c in coordinates]
        return df.where(~all_of([x.isNotNull() & ~F.isnan(x) for x in columns])).count()

    @property
    def x(self) -> list[Column]:
        return vector("x", self.d)

    def bounding_box(self, *by: str) -> DataFrame:
        """lo0.., hi0.., n: of all points or of each group."""
        return self.df.groupBy(*by).agg(*bounds(self.x), F.count(F.lit(1)).alias("n"))

    def with_df(self, df: DataFrame) -> Points:
        return Points(df, self.key, self.d)
