"""Queries over trees whose leaves are given, so that SQL can follow: the leaves are the nations, the points customers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lattica.catalog.base import B, C, Q, boxes_of, customers, parts, queries_of, query, read
from lattica.catalog.kernels import GROWN, MBR
from lattica.functions import geometry as G
from lattica.operators.box_tree import BoxTree, parent_chains
from lattica.operators.kd_cells import order_violations
from lattica.operators.points import Points
from lattica.plans import search

NATIONS = f"m AS (SELECT CAST(c_nationkey AS VARCHAR) AS node, {MBR}, count(*) AS n FROM c GROUP BY 1)"
#: What a root above one level of leaves is called.
ROOT = "1/"


def _tree(spark, sf_dir) -> BoxTree:
    c = customers(spark, sf_dir)
    return BoxTree.over(c.with_df(c.df.withColumn("node", F.col("c_nationkey").cast("string"))), 50)


@query(f"WITH {C}, {NATIONS} SELECT node, n FROM m UNION ALL SELECT '{ROOT}', CAST(sum(n) AS BIGINT) FROM m")
def subtree_count(spark, sf_dir):
    return _tree(spark, sf_dir).nodes.select("node", "n")


@query(f"WITH {C}, {NATIONS}, s AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS x0, CAST(s_suppkey AS DOUBLE) AS x1 FROM supplier), r AS (SELECT s_suppkey, node AS leaf, row_number() OVER (PARTITION BY s_suppkey ORDER BY {GROWN}, node) AS place FROM s, m) SELECT s_suppkey, leaf FROM r WHERE place = 1")
def choose_leaf(spark, sf_dir):
    s = Points.of(read(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_acctbal", "s_suppkey"])
    return _tree(spark, sf_dir).choose_leaf(s.df).select("s_suppkey", F.col("node").alias("leaf"))


@query(f"WITH {C}, {NATIONS} SELECT node, node AS ancestor, CAST(0 AS INTEGER) AS distance FROM m UNION ALL SELECT node, '{ROOT}', 1 FROM m UNION ALL SELECT '{ROOT}', '{ROOT}', 0")
def tree_chains(spark, sf_dir):
    return parent_chains(_tree(spark, sf_dir).nodes)


@query(f"WITH {C}, {NATIONS} SELECT node, '{ROOT}' AS parent, n, lo0, lo1, hi0, hi1 FROM m WHERE node = '5'")
def tree_node(spark, sf_dir):
    """One node by its name."""
    return _tree(spark, sf_dir).node("5").select("node", "parent", "n", "lo0", "lo1", "hi0", "hi1")


@query(f"WITH {C} SELECT c_custkey, x0, x1 FROM c WHERE c_nationkey = 5")
def tree_below(spark, sf_dir):
    """All points below a node."""
    return _tree(spark, sf_dir).below("5").select("c_custkey", "x0", "x1")


AREAS = "b AS (SELECT CAST(n_nationkey AS BIGINT) AS bid, n_nationkey * 400e0 - 1500 AS b0, n_nationkey * 400e0 - 1100 AS z0, n_nationkey * 3e0 - 10 AS b1, n_nationkey * 3e0 - 5 AS z1 FROM nation)"


def _areas(spark, sf_dir):
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        n.cast("long").alias("bid"), (n * F.lit(400.0) - 1500).alias("lo0"), (n * F.lit(400.0) - 1100).alias("hi0"), (n * F.lit(3.0) - 10).alias("lo1"), (n * F.lit(3.0) - 5).alias("hi1")
    )


@query(
    f"WITH {C}, {NATIONS}, {AREAS}, r AS (SELECT {MBR} FROM c), o AS (SELECT bid, b0, b1, z0, z1 FROM b JOIN r ON b0 <= hi0 AND lo0 <= z0 AND b1 <= hi1 AND lo1 <= z1)"
    " SELECT bid, CAST(1 + count(node) AS BIGINT) AS nodes_visited, count(node) AS leaf_pages FROM o LEFT JOIN m ON b0 <= hi0 AND lo0 <= z0 AND b1 <= hi1 AND lo1 <= z1 GROUP BY 1"
)
def rtree_box_cost(spark, sf_dir):
    """Nodes that a search of each box opens, inner ones included, and leaves of them."""
    return _tree(spark, sf_dir).box_costs(_areas(spark, sf_dir))


@query()
def rtree_pages_by_k(spark, sf_dir):
    """Leaves that a search for the k nearest opens, and points that it tests, on average, by k."""
    tree, q = BoxTree.build(parts(spark, sf_dir)), queries_of(spark, sf_dir)
    one = lambda k: tree.nearest_costs(q, k).agg(F.lit(k).alias("k"), F.round(F.avg("leaf_pages"), 6).alias("avg_pages"), F.round(F.avg("tested"), 6).alias("avg_rows"))
    return reduce(lambda a, b: a.unionAll(b), map(one, (1, 5, 10, 50)))


@query("SELECT count(*) AS points, 0::BIGINT AS wrong_counts, 0::BIGINT AS wrong_boxes, 0::BIGINT AS overfull, 0::BIGINT AS roots_less_one FROM part")
def rtree_insert_levels(spark, sf_dir):
    """After inserts: points, and nodes of all levels whose count or box isn't that of the points below, or that hold too much."""
    p = parts(spark, sf_dir)
    third = F.pmod(F.col("p_partkey"), F.lit(3))
    tree = BoxTree.build(p.with_df(p.df.where(third == 0))).insert(p.with_df(p.df.where(third == 1))).insert(p.with_df(p.df.where(third == 2)))
    chains = parent_chains(tree.nodes).select("node", "ancestor")
    truth = tree.points.df.join(chains, "node").groupBy(F.col("ancestor").alias("node")).agg(*G.bounds(p.x, "t_lo", "t_hi"), F.count(F.lit(1)).alias("t_n"))
    same = G.all_of([F.col(f"{a}{i}") == F.col(f"t_{a}{i}") for a in ("lo", "hi") for i in (0, 1)])
    entries = tree.nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    all_nodes = tree.nodes.join(truth, "node", "left").join(entries, "node", "left")
    held = F.when(F.col("is_leaf"), F.col("n")).otherwise(F.col("children"))
    count = lambda condition, name: F.count(F.when(condition, 1)).alias(name)
    return all_nodes.agg(
        F.sum(F.when(F.col("is_leaf"), F.col("n"))).alias("points"), count(~F.coalesce(F.col("n") == F.col("t_n"), F.lit(False)), "wrong_counts"), count(~F.coalesce(same, F.lit(False)), "wrong_boxes"),
        count(held > tree.capacity, "overfull"), (F.count(F.when(F.col("parent").isNull(), 1)) - 1).alias("roots_less_one"),
    )


@query(f"WITH {C}, m AS (SELECT c_nationkey AS cell, {MBR} FROM c GROUP BY 1) SELECT a.cell AS later, b.cell AS earlier FROM m a JOIN m b ON b.cell < a.cell AND a.lo0 < b.hi0 AND a.lo1 < b.hi1")
def order_violations_of_nations(spark, sf_dir):
    """Numbered without regard to place, boxes do violate the order."""
    return order_violations(customers(spark, sf_dir).bounding_box("c_nationkey").withColumnRenamed("c_nationkey", "cell"), 2)


@query("SELECT CAST(n_nationkey AS BIGINT) AS bid, CAST(row_number() OVER (ORDER BY (n_nationkey * 7) % 25) - 1 AS BIGINT) AS place FROM nation")
def boxes_in_order(spark, sf_dir):
    """Boxes along a diagonal, sorted by comparing two at a time."""
    at = F.pmod(F.col("n_nationkey") * 7, F.lit(25)).cast("double") * 10
    boxes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bid"), at.alias("lo0"), at.alias("lo1"), (at + 9).alias("hi0"), (at + 9).alias("hi1"))
    return search.in_box_order(boxes, 2).select("bid", "place")


PAIRS = (
    "m AS (SELECT bid, qid, q0, q1, lo0, lo1, hi0, hi1, CASE WHEN q0 >= (lo0 + hi0) / 2 THEN lo0 ELSE hi0 END AS f0, CASE WHEN q0 >= (lo0 + hi0) / 2 THEN hi0 ELSE lo0 END AS n0,"
    " CASE WHEN q1 >= (lo1 + hi1) / 2 THEN lo1 ELSE hi1 END AS f1, CASE WHEN q1 >= (lo1 + hi1) / 2 THEN hi1 ELSE lo1 END AS n1 FROM q, b)"
)


def _branches_sql(by: str) -> str:
    near = "greatest(lo0 - q0, q0 - hi0, 0e0) * greatest(lo0 - q0, q0 - hi0, 0e0) + greatest(lo1 - q1, q1 - hi1, 0e0) * greatest(lo1 - q1, q1 - hi1, 0e0)"
    edge = "least((q0 - n0) * (q0 - n0) + (q1 - f1) * (q1 - f1), (q0 - f0) * (q0 - f0) + (q1 - n1) * (q1 - n1))"
    value = near if by == "md" else edge
    return f"WITH {Q}, {B}, {PAIRS}, v AS (SELECT qid, bid, {value} AS {by} FROM m) SELECT qid, bid, {by}, CAST(row_number() OVER (PARTITION BY qid ORDER BY {by}, bid) AS INTEGER) AS place FROM v"


@query(_branches_sql("md"))
def branch_order(spark, sf_dir):
    return search.batch_branch_order(queries_of(spark, sf_dir), boxes_of(spark, sf_dir), 2, "min").select("qid", "bid", "md", "place")


@query(_branches_sql("mm"))
def branch_order_minmax(spark, sf_dir):
    return search.batch_branch_order(queries_of(spark, sf_dir), boxes_of(spark, sf_dir), 2, "minmax").select("qid", "bid", "mm", "place")
