"""Searches that come down a hierarchy of boxes, one equi-join for each level.

A level is a table of node, parent, lo0.., hi0.. and n (the points below); the first level is small and has no
parents. A query starts with all nodes of the first level and keeps those that can matter; only their children are
looked at. So no level is ever joined as a whole with all queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.geometry import bounds_of_boxes, boxes_overlap, max_distance_squared, min_distance_squared, min_max_distance_squared, vector
from lattica.sources.shared import salted_join

#: Nodes that the first level may have, and children of a node.
TOP, FAN = 256, 32
#: Share that bounds are widened by, for sums that are rounded in another order.
SLACK = 1e-12


def hierarchy(cells: DataFrame, d: int, cell: str = "cell", fans: Sequence[int] | None = None) -> list[DataFrame]:
    """Levels over cells that are numbered so that near numbers are near places: runs of them make the groups.

    fans: how many nodes each level above the cells takes together, from below; by default as many levels as leave
    TOP nodes at most.
    """
    lo, hi = vector("lo", d), vector("hi", d)
    level = cells.select(F.col(cell).cast("long").alias("node"), *lo, *hi, "n")
    if fans is None:
        most, fans = (cells.agg(F.max(cell)).first()[0] or 0) + 1, []
        while most > TOP:
            fans.append(FAN)
            most = -(-most // FAN)
    found = []
    for fan in fans:
        level = level.withColumn("parent", F.floor(F.col("node") / fan).cast("long"))
        found.append(level)
        level = level.groupBy(F.col("parent").alias("node")).agg(*bounds_of_boxes(lo, hi), F.sum("n").alias("n"))
    found.append(level.withColumn("parent", F.lit(None).cast("long")))
    return found[::-1]


def _next(kept: DataFrame | None, queries: DataFrame, level: DataFrame, d: int, query: str) -> DataFrame:
    """The queries with the nodes of a level below those that they kept; all nodes, on the first level."""
    own = level.select("node", "parent", *vector("lo", d), *vector("hi", d), "n")
    if kept is None:
        return queries.crossJoin(F.broadcast(own.drop("parent")))  # the first level has few nodes by construction
    return salted_join(kept.withColumnRenamed("node", "parent"), own, ["parent"], [query]).drop("parent")


def near_nodes(queries: DataFrame, levels: Sequence[DataFrame], k: int, d: int) -> DataFrame:
    """qid, q0.., node, md: for each query the nodes of the last level that can hold one of its k nearest points.

    Boxes are minimal, so each bounds the k-th distance in two ways: boxes in the order of their farthest corners
    are summed up until they hold k points; and of k boxes each has a point within its MINMAXDIST. Nodes whose near
    side lies beyond the best bound so far are dropped. Fewer than k points in all keep every node.
    """
    q, lo, hi = vector("q", d), vector("lo", d), vector("hi", d)
    found, own = None, W.partitionBy("qid")
    for level in levels:
        pairs = _next(found, queries.select("qid", *q, F.lit(float("inf")).alias("reach")), level, d, "qid")
        pairs = pairs.select("qid", *q, "node", "n", "reach", min_distance_squared(q, lo, hi).alias("md"), max_distance_squared(q, lo, hi).alias("mx"), min_max_distance_squared(q, lo, hi).alias("mm"))
        pairs = pairs.withColumn("held", F.sum("n").over(own.orderBy("mx", "node"))).withColumn("place", F.row_number().over(own.orderBy("mm", "node")))
        by_count, by_box = F.min(F.when(F.col("held") >= k, F.col("mx"))).over(own), F.min(F.when(F.col("place") >= k, F.col("mm"))).over(own)
        inf = F.lit(float("inf"))
        pairs = pairs.withColumn("now", F.least("reach", F.coalesce(by_count, inf), F.coalesce(by_box, inf)))
        found = pairs.where(F.col("md") <= F.col("now") * (1 + SLACK)).select("qid", *q, "node", "md", F.col("now").alias("reach"))
        found, last = found.drop("md"), found
    return last.drop("reach")


def met_nodes(boxes: DataFrame, levels: Sequence[DataFrame], d: int, meets: Callable[..., Column] = boxes_overlap) -> DataFrame:
    """bid, a0.., b0.. (the box) and node: the nodes of the last level that each box meets. boxes: bid, lo0.., hi0.. .

    meets: a condition on the corners of the box and of a node, in this order, that holds for a node wherever it
    holds for one below it.
    """
    a, b = vector("a", d), vector("b", d)
    asked = boxes.select("bid", *[F.col(f"lo{i}").alias(f"a{i}") for i in range(d)], *[F.col(f"hi{i}").alias(f"b{i}") for i in range(d)])
    found = None
    for level in levels:
        pairs = _next(found, asked, level, d, "bid")
        found = pairs.where(meets(a, b, vector("lo", d), vector("hi", d))).select("bid", *a, *b, "node")
    return found


def reached_nodes(boxes: DataFrame, levels: Sequence[DataFrame], d: int) -> DataFrame:
    """bid, level (0 the lowest) and the number of nodes of each level that a search of each box opens."""
    counts = []
    for i in range(1, len(levels) + 1):
        opened = met_nodes(boxes, levels[:i], d)
        counts.append(opened.groupBy("bid").agg(F.count(F.lit(1)).alias("nodes")).withColumn("level", F.lit(len(levels) - i)))
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
