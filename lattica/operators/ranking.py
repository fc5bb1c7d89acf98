"""Exact global ranks without a sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.sources.shared import shuffle_width, stash


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """df with its rank from 0 by the order columns, which must be unique together.

    Rows are dealt by ranges and sorted within them; a row's rank is its place there plus the sizes of the ranges
    before, of which there are as many as partitions.
    """
    dealt = df.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    low = (1 << 33) - 1
    placed = dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(low)).drop("_id")
    placed = stash(placed, "ranked")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def equal_parts(df: DataFrame, parts: int, rank: str = "rank", name: str = "part", within: str | None = None) -> DataFrame:
    """df with a part from 0: ranks cut into parts whose sizes differ by one at most, larger ones first.

    within names a column for the rank within the part, from 0: what is left of the rank, by arithmetic alone.
    """
    n = df.count()
    small, larger = divmod(n, parts)
    edge = larger * (small + 1)
    r = F.col(rank)
    part = F.when(r < edge, F.floor(r / (small + 1)))
    part = part.otherwise(larger + F.floor((r - edge) / small)) if small else part.otherwise(F.lit(larger))
    df = df.withColumn(name, part.cast("int"))
    if not within:
        return df
    p = F.col(name).cast("long")
    start = F.when(p < larger, p * (small + 1)).otherwise(edge + (p - larger) * small)
    return df.withColumn(within, r - start)


def chunk_starts(n: int, chunks: int) -> list[int]:
    """The ranks at which equal chunks begin, larger ones first; chunks that would be empty have none."""
    small, larger = divmod(n, chunks)
    starts = [i * (small + 1) for i in range(larger)] + [larger * (small + 1) + i * small for i in range(chunks - larger)]
    return [s for i, s in enumerate(starts) if s < n and (i == 0 or s > starts[i - 1])]


def values_at(df: DataFrame, column: str, chunks: int) -> tuple[list[float], float | None]:
    """The smallest value of each of `chunks` equal chunks of the sorted column, and the largest value of all.

    Equal values are counted first, so a value that fills half the table is one row. Ranks come from range
    partitions; only the chunks' values reach the driver.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    dealt = stash(counts.repartitionByRange(shuffle_width(df.sparkSession), column).withColumn("r", F.spark_partition_id()), "values")
    sizes = dealt.groupBy("r").agg(F.sum("n").alias("n"), F.max(column).alias("most")).orderBy("r").collect()
    total = sum(row["n"] for row in sizes)
    if not total:
        return [], None
    before, offset = {}, 0
    for row in sizes:
        before[row["r"]] = offset
        offset += row["n"]
    starts = chunk_starts(total, chunks)
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("r")]
    end = shift + F.sum("n").over(W.partitionBy("r").orderBy(column))
    hit = dealt.select(column, end.alias("end"), (end - F.col("n")).alias("start"))
    hit = hit.where(F.exists(F.array(*[F.lit(s) for s in starts]), lambda s: (s >= F.col("start")) & (s < F.col("end"))))
    found = sorted(row[column] for row in hit.select(column).collect())
    return found, max(row["most"] for row in sizes)
