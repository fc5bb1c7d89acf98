"""Made points and boxes, and points taken from images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pixels (row, column) of a 32 x 32 image whose colours make points, pair by pair.
PIXEL_PAIRS = (((4, 4), (4, 12)), ((12, 4), (12, 12)), ((20, 20), (20, 28)), ((28, 20), (28, 28)))


def uniform_points(spark: SparkSession, n: int, d: int, low: float, high: float, seed: int = 42) -> DataFrame:
    """pid and x0.. : n independent points, the same for the same seed and partitions."""
    coordinates = [(F.lit(low) + F.rand(seed + i) * F.lit(high - low)).alias(f"x{i}") for i in range(d)]
    return spark.range(n).select(F.col("id").alias("pid"), *coordinates)


def query_points(spark: SparkSession, n: int, d: int, low: float, high: float, seed: int = 7) -> DataFrame:
    """qid and q0.. : n independent places to search around."""
    made = uniform_points(spark, n, d, low, high, seed)
    return made.select(F.col("pid").alias("qid"), *[F.col(f"x{i}").alias(f"q{i}") for i in range(d)])


def query_boxes(spark: SparkSession, mins: Sequence[float], maxs: Sequence[float], n: int = 100, side: float = 0.25, seed: int = 42) -> DataFrame:
    """bid, lo0.., hi0.. : lower corners between the least and the largest bound, sides up to a share of each dimension's extent."""
    low, high = min(mins), max(maxs)
    d = len(mins)
    lo = [(F.lit(low) + F.rand(seed + i) * F.lit(high - low)).alias(f"lo{i}") for i in range(d)]
    boxes = spark.range(n).select(F.col("id").alias("bid"), *lo)
    sides = [F.rand(seed + d + i) * F.lit(side * (maxs[i] - mins[i])) for i in range(d)]
    return boxes.select("*", *[(F.col(f"lo{i}") + s).alias(f"hi{i}") for i, s in enumerate(sides)])


def pixel(image: Column, row: int, column: int) -> list[Column]:
    """Red, green and blue of a pixel of a channel-planar image of 3 x 32 x 32 values."""
    return [F.get(image, 1024 * channel + 32 * row + column) for channel in range(3)]


def image_points(images: DataFrame, image: str) -> DataFrame:
    """x0 .. x5: two pixels' colours make a point, four points an image; each distinct point once."""
    points = [F.struct(*[v.alias(f"x{i}") for i, v in enumerate(pixel(F.col(image), *a) + pixel(F.col(image), *b))]) for a, b in PIXEL_PAIRS]
    return images.select(F.explode(F.array(*points)).alias("p")).select("p.*").distinct()
