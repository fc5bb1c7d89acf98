"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stash

#: Keys that hold more than this share of all rows are heavy: so there are never more of them than its inverse.
SHARE, FEW = 500, 2000
#: Edges that one task takes to their end: 16 bytes each, and as many again a few times. More go through rounds.
TASK_EDGES = 500_000


def join_least(rows: DataFrame, least: DataFrame, key: str, limit: int) -> DataFrame:
    """rows joined with least (key, m, and n, at least the number of the key's rows).

    Rows of keys with more than limit rows stay where they are: what those keys have in least, a few rows, is sent
    to them. All others meet by a shuffle.
    """
    heavy = least.where(F.col("n") > limit).select(key, "m").collect()
    light = least.where(F.col("n") <= limit).select(key, "m")
    if not heavy:
        return rows.join(light, key)
    sent = F.broadcast(rows.sparkSession.createDataFrame(heavy, light.schema))
    return rows.join(sent, key).unionByName(rows.join(sent.select(key), key, "left_anti").join(light, key))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, and the smallest node that each reaches: hung on smaller roots, paths halved, until no edge joins two."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if np.array_equal(x, y):
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def in_one_task(edges: DataFrame) -> DataFrame:
    """node, component of a graph of few edges: u, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        nodes, least = least_reached(held.column("u").to_numpy(), held.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest id that it reaches) for every node with an edge to another.

    edges: a, b (bigint). Each round hangs neighbours on the smallest one known, first the larger neighbours of
    a node, then the smaller; the edges end as stars. Rounds grow with the logarithm of the longest path. Only
    a count, a checksum and at most SHARE heavy nodes reach the driver; each round is a written table, so lost
    executors cost one round. Edges may repeat; edges of a node with itself, or with a null, are left out, and an
    empty table gives no rows. Other columns are ignored. What has come down to TASK_EDGES edges ends in one task:
    a round is some twenty jobs, each of which the driver keeps something of.
    """
    apart = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now, seen = stash(apart.distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        if mark["n"] <= TASK_EDGES:
            return stash(in_one_task(now), "components")
        seen, limit = mark, max(FEW, 2 * mark["n"] // SHARE)
        both = now.union(now.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        large = join_least(both.where("y > x"), least, "x", limit).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_least(large, low, "u", limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stash(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
