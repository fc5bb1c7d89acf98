"""A tree of bounding boxes, built in bulk by two-means splits and kept as two tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.geometry import boxes_overlap, bounds, bounds_of_boxes, centre, constants, enlargement, in_box, vector
from lattica.operators.points import Points
from lattica.plans.descend import near_nodes, reached_nodes
from lattica.plans.search import at_point, indexed_nearest
from lattica.sources.shared import bounded_broadcast, salted_join, stash

#: Entries of a node, rows of a group that one task splits, and rows on whose two-means larger groups are split.
CAPACITY, TASK_ROWS, SAMPLE = 50, 50_000, 100_000


def rebalance(side: np.ndarray, x: np.ndarray, centres: np.ndarray, least: int) -> np.ndarray:
    """Moves the rows nearest to the short side's centre over to it, until it has `least` rows."""
    short = int(np.bincount(side, minlength=2)[1] < np.bincount(side, minlength=2)[0])
    missing = least - int((side == short).sum())
    if missing > 0:
        others = np.flatnonzero(side != short)
        far = ((x[others] - centres[short]) ** 2).sum(1)
        side = side.copy()
        side[others[np.argsort(far, kind="stable")[:missing]]] = short
    return side


def two_means(x: np.ndarray, least: int, rounds: int = 20) -> np.ndarray:
    """0 or 1 for each row: Lloyd's rounds from the point farthest from the mean and the point farthest from that.

    Both sides get `least` rows (half, if there are fewer than twice as many). Points that are all alike are halved.
    """
    least = min(least, len(x) // 2)
    a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    b = x[np.argmax(((x - a) ** 2).sum(1))]
    centres = np.stack([a, b])
    side = np.zeros(len(x), int)
    for _ in range(rounds):
        moved = (((x - centres[1]) ** 2).sum(1) < ((x - centres[0]) ** 2).sum(1)).astype(int)
        if (moved == side).all() and _:
            break
        side = moved
        for s in (0, 1):
            if (side == s).any():
                centres[s] = x[side == s].mean(0)
    if side.min() == side.max():
        side = (np.arange(len(x)) >= len(x) // 2).astype(int)
    return rebalance(side, x, centres, least)


def split_until(x: np.ndarray, capacity: int) -> list[str]:
    """For each row the path of splits to a group of at most capacity rows."""
    paths, work = [""] * len(x), [(np.arange(len(x)), "")]
    while work:
        rows, path = work.pop()
        if len(rows) <= capacity:
            for i in rows:
                paths[i] = path
            continue
        side = two_means(x[rows], capacity // 2)
        work += [(rows[side == s], path + str(s)) for s in (0, 1)]
    return paths


def split_plan(x: np.ndarray, least: int) -> list[tuple]:
    """Two-means splits of a sample down to groups of `least` rows: (path, centre of its side 0, centre of its side 1).

    A group of points that are all alike has no centres: its rows are halved by a hash.
    """
    found, work = [], [(np.arange(len(x)), "")]
    while work:
        rows, path = work.pop()
        if len(rows) < 2 * least:
            continue
        if (x[rows] == x[rows[0]]).all():
            found.append((path, None, None))
            work += [(rows[i::2], path + str(i)) for i in (0, 1)]
            continue
        side = two_means(x[rows], max(1, len(rows) // 8))
        found.append((path, x[rows[side == 0]].mean(0), x[rows[side == 1]].mean(0)))
        work += [(rows[side == i], path + str(i)) for i in (0, 1)]
    return found


def follow(x: np.ndarray, hashes: np.ndarray, plan: dict[str, tuple]) -> list[str]:
    """The path of each row down a plan of splits."""
    paths, work = [""] * len(x), [(np.arange(len(x)), "")]
    while work:
        rows, path = work.pop()
        if path not in plan:
            for i in rows:
                paths[i] = path
            continue
        a, b = plan[path]
        if a is None:
            side = (hashes[rows] >> len(path) % 60) & 1
        else:
            side = (((x[rows] - b) ** 2).sum(1) < ((x[rows] - a) ** 2).sum(1)).astype(int)
        work += [(rows[side == i], path + str(i)) for i in (0, 1)]
    return paths


def coarse_groups(df: DataFrame, d: int, task_rows: int) -> DataFrame:
    """df with path, groups of at most some task_rows rows.

    Two-means splits of a sample of at most SAMPLE rows, drawn by a hash and split on the driver, are followed by all
    rows in one pass. Groups that still are more than twice too large, as a sample for them was too small, are split
    in the same way again.
    """
    df, axes = df.withColumn("path", F.lit("")), [f"x{i}" for i in range(d)]
    draw = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30))
    while True:
        sizes = df.groupBy("path").count()
        large = sizes.where(F.col("count") > 2 * task_rows)
        heads = large.agg(F.count(F.lit(1)).alias("groups"), F.sum("count").alias("rows")).first()
        if not heads["groups"]:
            return df
        share = min(1.0, SAMPLE / heads["rows"])
        wanted = bounded_broadcast(large.select("path"))
        sample = df.join(wanted, "path", "left_semi").where(draw < int(share * (1 << 30)) + 1).select("path", *axes).limit(2 * SAMPLE).toPandas()
        least = max(2, round(task_rows * share))
        plan: dict[str, tuple] = {}
        for path, rows in sample.groupby("path"):
            found = split_plan(rows[axes].to_numpy(float), least) or [("", None, None)]
            plan |= {path + p: (a, b) for p, a, b in found}
        if not plan:
            plan = {row["path"]: (None, None) for row in large.select("path").limit(SAMPLE).collect()}

        def one(batches: Iterator[pd.DataFrame], plan=plan) -> Iterator[pd.DataFrame]:
            for rows in batches:
                out = rows.copy()
                x, hashes = rows[axes].to_numpy(float), rows["_hash"].to_numpy()
                for path, at in rows.groupby("path").indices.items():
                    below = {p[len(path) :]: c for p, c in plan.items() if p.startswith(path)} if path else plan
                    out.iloc[at, out.columns.get_loc("path")] = [path + p for p in follow(x[at], hashes[at], below)]
                yield out.drop(columns="_hash")

        df = stash(df.withColumn("_hash", F.xxhash64(*df.columns)).mapInPandas(one, df.schema), "tree-split")


def grouped(df: DataFrame, key: Sequence[str], d: int, level: int, capacity: int, task_rows: int) -> DataFrame:
    """key and node: groups of at most capacity rows; a node is named after its level and its path of splits."""
    coarse = coarse_groups(df.select(*key, *vector("x", d)), d, task_rows)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(key))
        paths = split_until(rows[[f"x{i}" for i in range(d)]].to_numpy(float), capacity)
        return rows[list(key)].assign(node=[f"{level}/{a}{b}" for a, b in zip(rows["path"], paths, strict=True)])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    return coarse.groupBy("path").applyInPandas(one, f"{kinds}, node string")


@dataclass(frozen=True)
class BoxTree:
    """nodes: node, parent, level, is_leaf, n, lo0.., hi0.. ; points.df has node, its leaf."""

    points: Points
    nodes: DataFrame
    capacity: int

    @classmethod
    def build(cls, points: Points, capacity: int = CAPACITY, task_rows: int = TASK_ROWS) -> BoxTree:
        """Groups points into leaves, then boxes by their centres into parents, until one node holds all."""
        d = points.d
        leaves = grouped(points.df, points.key, d, 0, capacity, task_rows)
        placed = stash(points.df.join(leaves, list(points.key)), "tree-points")
        return cls.over(points.with_df(placed), capacity, task_rows)

    def visited(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        """Nodes that a search of the box opens: those whose box meets it. A parent's box holds its children's."""
        d = self.points.d
        return self.nodes.where(boxes_overlap(vector("lo", d), vector("hi", d), constants(lo), constants(hi)))

    def search(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        """Points of the box, with their leaves: only points of leaves that meet the box are tested."""
        leaves = self.visited(lo, hi).where("is_leaf").select("node")
        return self.points.df.join(leaves, "node").where(in_box(self.points.x, constants(lo), constants(hi)))

    def find(self, p: Sequence[float]) -> DataFrame:
        """All points at a place, with their leaves."""
        leaves = self.visited(p, p).where("is_leaf").select("node")
        return at_point(self.points.df.join(leaves, "node"), p)

    def levels(self) -> list[DataFrame]:
        """The nodes of each level, from the root, which is one; so searches come down by the tree's own branches."""
        height = self.nodes.agg(F.max("level")).first()[0] or 0
        columns = ["node", "parent", *vector("lo", self.points.d), *vector("hi", self.points.d), "n"]
        return [self.nodes.where(F.col("level") == i).select(*columns) for i in range(height, -1, -1)]

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """Each query's k nearest; leaves take the place of cells."""
        return indexed_nearest(self.points, self.nodes.where("is_leaf"), queries, k, "node", self.levels())

    def nearest_costs(self, queries: DataFrame, k: int) -> DataFrame:
        """qid, leaf_pages, tested: leaves within reach of a query's k nearest, and their points."""
        near = near_nodes(queries, self.levels(), k, self.points.d).select("qid", "node")
        leaves = salted_join(near, self.nodes.where("is_leaf").select("node", "n"), ["node"], ["qid"])
        return leaves.groupBy("qid").agg(F.count(F.lit(1)).alias("leaf_pages"), F.sum("n").alias("tested"))

    def box_costs(self, boxes: DataFrame) -> DataFrame:
        """bid, nodes_visited (inner ones included) and leaf_pages of a search of each box."""
        opened = reached_nodes(boxes, self.levels(), self.points.d)
        return opened.groupBy("bid").agg(F.sum("nodes").alias("nodes_visited"), F.coalesce(F.sum(F.when(F.col("level") == 0, F.col("nodes"))), F.lit(0)).alias("leaf_pages"))

    def node(self, name: str) -> DataFrame:
        """The node of this name; none, if there is none."""
        return self.nodes.where(F.col("node") == name)

    def below(self, name: str) -> DataFrame:
        """All points below a node."""
        leaves = parent_chains(self.nodes).where(F.col("ancestor") == name).select("node")
        return self.points.df.join(leaves, "node")

    def choose_leaf(self, points: DataFrame) -> DataFrame:
        """points (x0.. and more) with node, the leaf whose box grows least to take each, ties by name.

        Leaves are compared level by level: of a node's children the one that grows least is followed.
        """
        d, df = self.points.d, points
        x, lo, hi = vector("x", d), vector("lo", d), vector("hi", d)
        root = self.nodes.where("parent is null").select(F.col("node").alias("_at"), "level").first()
        if root is None:
            return df.withColumn("node", F.lit(None).cast("string"))
        df = df.withColumn("_row", F.struct(*df.columns)).select("_row", *x, F.lit(root["_at"]).alias("_at"))
        for _ in range(root["level"]):
            children = self.nodes.where("parent is not null").select("node", F.col("parent").alias("_at"), *lo, *hi)
            pairs = salted_join(df, children, ["_at"], ["_row"]).select("_row", *x, "node", enlargement(x, lo, hi).alias("_grown"))
            df = pairs.groupBy("_row", *x).agg(F.min_by("node", F.struct("_grown", "node")).alias("_at"))
        return df.select("_row.*", F.col("_at").alias("node"))

    def insert(self, batch: Points) -> BoxTree:
        """The tree with more points: each goes to the leaf that grows least, and leaves over capacity are split.

        Only points of leaves that take new ones are written; all others stay in the files they are in. The nodes
        above are made of the leaves' boxes again, of which there are N / capacity; no other point is looked at.
        """
        if self.nodes.limit(1).count() == 0:
            return BoxTree.build(batch, self.capacity)
        d, key = self.points.d, list(self.points.key)
        names = [*key, *[f"x{i}" for i in range(d)], "node"]
        fresh = stash(self.choose_leaf(batch.df).select(*names), "tree-insert")
        touched = stash(fresh.select("node").distinct(), "tree-touched")
        held = self.points.df.select(*names)
        capacity = self.capacity

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(key)
            paths = split_until(rows[[f"x{i}" for i in range(d)]].to_numpy(float), capacity)
            return rows.assign(node=[a + b for a, b in zip(rows["node"], paths, strict=True)])[names]

        # A leaf has at most its capacity and what the batch brings; a batch that fills one leaf is split coarsely first.
        both = held.join(bounded_broadcast(touched), "node", "left_semi").select(*names).unionByName(fresh)
        sizes = both.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
        huge = sizes.where(F.col("_n") > TASK_ROWS).select("node")
        if huge.limit(1).count():
            again = both.join(bounded_broadcast(huge), "node", "left_semi")
            again = again.drop("node").join(grouped(again, key, d, 0, capacity, TASK_ROWS).withColumn("node", F.concat(F.lit("+"), "node")), key).select(*names)
            both = both.join(bounded_broadcast(huge), "node", "left_anti").select(*names)
            split = both.groupBy("node").applyInPandas(one, both.schema).unionByName(again)
        else:
            split = both.groupBy("node").applyInPandas(one, both.schema)
        changed = stash(split, "tree-changed")
        rest = held.join(bounded_broadcast(touched), "node", "left_anti").select(*names)
        lo, hi = vector("lo", d), vector("hi", d)
        kept = self.nodes.where("is_leaf").join(touched, "node", "left_anti").select("node", *lo, *hi, "n")
        leaves = kept.unionByName(changed.groupBy("node").agg(*bounds(vector("x", d)), F.count(F.lit(1)).alias("n")))
        placed = self.points.with_df(rest.unionByName(changed))
        return BoxTree(placed, _levels_above(leaves.withColumn("level", F.lit(0)), d, capacity, TASK_ROWS), capacity)

    @classmethod
    def over(cls, placed: Points, capacity: int, task_rows: int = TASK_ROWS) -> BoxTree:
        """The tree above leaves that are already there."""
        d = placed.d
        level = placed.df.groupBy("node").agg(*bounds(vector("x", d)), F.count(F.lit(1)).alias("n")).withColumn("level", F.lit(0))
        return cls(placed, _levels_above(level, d, capacity, task_rows), capacity)


def _parents(middle: DataFrame, d: int, number: int, capacity: int, task_rows: int) -> DataFrame:
    """node and parent: boxes grouped by their centres."""
    return grouped(middle.withColumnRenamed("node", "child"), ["child"], d, number, capacity, task_rows).select(F.col("child").alias("node"), F.col("node").alias("parent"))


def _levels_above(level: DataFrame, d: int, capacity: int, task_rows: int) -> DataFrame:
    """All nodes, given the lowest."""
    lo, hi = vector("lo", d), vector("hi", d)
    columns = ["node", "parent", "level", (F.col("level") == 0).alias("is_leaf"), "n", *lo, *hi]
    nodes, number = None, 0
    while True:
        level = stash(level, "tree-level")
        last = level.count() <= 1
        if last:
            done = level.withColumn("parent", F.lit(None).cast("string"))
        else:
            number += 1
            middle = level.select("node", *[c.alias(f"x{i}") for i, c in enumerate(centre(lo, hi))])
            done = stash(level.join(_parents(middle, d, number, capacity, task_rows), "node"), "tree-parents")
            level = done.groupBy(F.col("parent").alias("node")).agg(*bounds_of_boxes(lo, hi), F.sum("n").alias("n")).withColumn("level", F.lit(number))
        nodes = done.select(*columns) if nodes is None else nodes.unionAll(done.select(*columns))
        if last:
            return nodes


def parent_chains(nodes: DataFrame) -> DataFrame:
    """node, ancestor, distance: every node with itself and all above it. One join for each level."""
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    found, step = own, own
    up = nodes.select(F.col("node").alias("ancestor"), "parent").where("parent is not null")
    height = nodes.agg(F.max("level")).first()[0] or 0
    for i in range(height):
        step = step.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(i + 1).alias("distance"))
        found = found.unionAll(step)
    return found
