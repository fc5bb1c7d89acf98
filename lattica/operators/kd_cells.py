"""Cells as leaves of a KD-tree, in the order of the tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.geometry import all_of, bounds, vector
from lattica.operators.points import Points
from lattica.operators.ranking import global_rank
from lattica.plans.descend import hierarchy, met_nodes
from lattica.sources.shared import bounded_broadcast, stash

#: Rows of a node up to which one task ranks it; larger ones are ranked over range partitions, with the same ranks.
EXACT = 1_000_000
#: Rows of a node up to which one task splits it down to its leaves.
TASK_ROWS = 100_000


def split_level(df: DataFrame, x: str, key: tuple[str, ...], leaf: int, exact: int = EXACT) -> DataFrame:
    """Halves every node of more than leaf points by rank in x, ties by the key: the left half keeps 2 * node, the right gets 2 * node + 1.

    The left half is the larger by one where the number is odd, whatever the size of the node.
    """
    sizes = stash(df.groupBy("node").agg(F.count(F.lit(1)).alias("_n")), "kd-sizes")
    large = F.col("_n") > max(exact, leaf)
    any_large = sizes.where(large).limit(1).count() > 0
    # Nodes that are still split here have more than a task's rows each; each carries two numbers.
    df = df.join(bounded_broadcast(sizes), "node")
    rest = df.where(~large) if any_large else df
    halved = rest.withColumn("_right", F.ntile(2).over(W.partitionBy("node").orderBy(x, *key)) - 1)
    if any_large:
        ranked = global_rank(df.where(large), ("node", x, *key), "_rank")
        # A node's ranks follow those of the large nodes before it.
        big = sizes.where(large)
        first = big.select("node", (F.sum("_n").over(W.orderBy("node")) - F.col("_n")).alias("_first"))
        right = (F.col("_rank") - F.col("_first") >= F.ceil(F.col("_n") / 2)).cast("int")
        halved = halved.unionByName(ranked.join(first, "node").withColumn("_right", right).drop("_rank", "_first"))
    split = F.col("_n") > leaf
    return halved.withColumn("node", F.when(split, 2 * F.col("node") + F.col("_right")).otherwise(F.col("node"))).drop("_n", "_right")


def split_rows(node: int, level: int, x: np.ndarray, leaf: int, levels: int | None = None) -> np.ndarray:
    """The leaf of each row, given the node that holds them all and its level; rows in the order of their keys."""
    nodes = np.full(len(x), node, np.int64)
    work = [(np.arange(len(x)), level)]
    while work:
        rows, depth = work.pop()
        if len(rows) <= leaf or depth == levels:
            continue
        order = rows[np.argsort(x[rows, depth % x.shape[1]], kind="stable")]
        half = -(-len(order) // 2)
        left, right = np.sort(order[:half]), np.sort(order[half:])
        nodes[left], nodes[right] = 2 * nodes[left], 2 * nodes[right] + 1
        work += [(left, depth + 1), (right, depth + 1)]
    return nodes


def kd_nodes(points: Points, leaf: int, task_rows: int = TASK_ROWS, levels: int | None = None) -> DataFrame:
    """The points with node, a leaf of at most `leaf` points (1 is the root); dimensions take turns.

    levels: how often a node is halved at most, for trees of a given depth; leaves that deep have any number of points.

    Nodes are halved by exact rank, ties by the key, so a node of points that are all alike is halved like any other,
    and the depth is that of N / leaf. Nodes of more than task_rows points are halved level by level over all tasks;
    then each is one task's work, down to its leaves: one shuffle, however many levels are left.
    """
    df, level, d = points.df.withColumn("node", F.lit(1).cast("long")), 0, points.d
    large = max(task_rows, leaf)
    while level != levels and df.groupBy("node").count().where(F.col("count") > large).limit(1).count():
        df = stash(split_level(df, f"x{level % d}", points.key, large), "kd-level")
        level += 1
    key, names = list(points.key), df.columns

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        node = int(rows["node"].iloc[0])
        x = rows[[f"x{i}" for i in range(d)]].to_numpy(float)
        return rows.assign(node=split_rows(node, node.bit_length() - 1, x, leaf, levels))[names]

    if level != levels:
        return stash(df.groupBy("node").applyInPandas(one, df.schema), "kd-leaves")
    # Leaves of the last level can have more points than a task takes, and aren't split.
    deep = F.col("node") >= F.lit(1 << levels)
    return stash(df.where(~deep).groupBy("node").applyInPandas(one, df.schema).unionByName(df.where(deep)), "kd-leaves")


def kd_cells(nodes: DataFrame, d: int, border_eps: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Points with cell and mapping, and the cells: cell, node, lo0.., hi0.., n.

    Cells are numbered from left to right. The mapping is the cell's number plus the fraction of its box, whose
    upper sides are border_eps farther out.
    """
    x, lo, hi = vector("x", d), vector("lo", d), vector("hi", d)
    boxes = nodes.groupBy("node").agg(*bounds(x), F.count(F.lit(1)).alias("n"))
    # From left to right: by the path from the root, as binary digits without the leading one.
    path = F.substring(F.conv(F.col("node").cast("string"), 10, 2), 2, 64)
    cells = stash(global_rank(boxes.withColumn("_path", path), ["_path"], "cell").drop("_path"), "kd-cells")
    df = nodes.join(bounded_broadcast(cells.select("node", "cell", *lo, *hi)), "node")
    part = whole = F.lit(1.0)
    for a, b, c in zip(x, lo, hi, strict=True):
        part, whole = part * (a - b), whole * (c + F.lit(border_eps) - b)
    return df.withColumn("mapping", F.col("cell") + part / whole).drop(*[f"lo{i}" for i in range(d)], *[f"hi{i}" for i in range(d)]), cells


def order_violations(cells: DataFrame, d: int) -> DataFrame:
    """Pairs of cells, later before earlier in every dimension: all(lo_later < hi_earlier).

    A check for numberings from elsewhere: kd_cells() has no such pair. Each cell comes down a hierarchy of runs of
    cells, with the number as one more dimension, so in a good order it meets little but the runs that it is in.
    """
    number = F.col("cell").cast("double")
    boxes = cells.select("cell", *vector("lo", d), *vector("hi", d), number.alias(f"lo{d}"), number.alias(f"hi{d}"), F.lit(1).alias("n"))

    def later_yet_before(lo1, hi1, lo2, hi2):
        return all_of([a < b for a, b in zip(lo2[:d], hi1[:d], strict=True)]) & (hi2[d] > lo1[d])

    pairs = met_nodes(boxes.withColumnRenamed("cell", "bid"), hierarchy(boxes, d + 1), d + 1, later_yet_before)
    return pairs.select(F.col("node").cast(cells.schema["cell"].dataType).alias("later"), F.col("bid").alias("earlier"))
