"""Queries over geometry kernels and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.base import B, C, L, P, boxes_of, customers, lines, number, parts, query, read
from lattica.functions import geometry as G
from lattica.operators.points import Points
from lattica.plans import search

Q2, Q4, BOX = (25.0, 950.0), (25.0, 50000.0, 0.05, 0.04), ((10.0, 920.0), (30.0, 960.0))


def squares(q):
    return " + ".join(f"(x{i} - {number(v)}) * (x{i} - {number(v)})" for i, v in enumerate(q))


@query(f"WITH {P} SELECT p_partkey, {squares(Q2)} AS d2 FROM p")
def dist_sq_2d(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.df.select("p_partkey", G.distance_squared(p.x, G.constants(Q2)).alias("d2"))


@query(f"WITH {L} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {squares(Q4)} AS d2 FROM l")
def dist_sq_4d(spark, sf_dir):
    p = lines(spark, sf_dir)
    return p.df.select(*p.key, G.distance_squared(p.x, G.constants(Q4)).alias("d2"))


@query(f"WITH {P} SELECT p_partkey, sqrt({squares(Q2)}) AS dist FROM p")
def dist_l2(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.df.select("p_partkey", G.distance(p.x, G.constants(Q2)).alias("dist"))


@query("WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 9) AS d2 FROM embeddings, q")
def dist_embedding(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("e"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(G.array_distance_squared(F.col("embedding"), F.col("e")), 9).alias("d2"))


@query(f"WITH {P} SELECT p_partkey, x0 BETWEEN 10e0 AND 30e0 AND x1 BETWEEN 920e0 AND 960e0 AS inside FROM p")
def point_in_box(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.df.select("p_partkey", G.in_box(p.x, *map(G.constants, BOX)).alias("inside"))


@query("SELECT s_suppkey, s_acctbal <= 500e0 AND 0e0 <= s_acctbal + 100e0 AS meets FROM supplier")
def interval_overlap(spark, sf_dir):
    a = F.col("s_acctbal")
    return read(spark, sf_dir, "supplier").select("s_suppkey", G.intervals_overlap(a, a + F.lit(100.0), F.lit(0.0), F.lit(500.0)).alias("meets"))


MBR = "min(x0) AS lo0, min(x1) AS lo1, max(x0) AS hi0, max(x1) AS hi1"


@query(f"WITH {C}, m AS (SELECT c_nationkey AS k, {MBR} FROM c GROUP BY 1) SELECT a.k AS a, b.k AS b FROM m a JOIN m b ON a.k < b.k AND a.lo0 <= b.hi0 AND b.lo0 <= a.hi0 AND a.lo1 <= b.hi1 AND b.lo1 <= a.hi1")
def box_overlap_selfjoin(spark, sf_dir):
    m = customers(spark, sf_dir).bounding_box("c_nationkey")
    lo_a, hi_a, lo_b, hi_b = (G.vector(x, 2, t) for t in "ab" for x in ("lo", "hi"))
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.c_nationkey") < F.col("b.c_nationkey")) & G.boxes_overlap(lo_a, hi_a, lo_b, hi_b)).select(F.col("a.c_nationkey").alias("a"), F.col("b.c_nationkey").alias("b"))


@query(f"WITH {C}, m AS (SELECT c_nationkey AS k, {MBR} FROM c GROUP BY 1) SELECT a.k AS a, b.k AS b, CASE WHEN a.hi0 > b.lo0 AND a.hi1 > b.lo1 THEN 1 ELSE -1 END AS comes FROM m a JOIN m b ON a.k <> b.k")
def box_order(spark, sf_dir):
    m = customers(spark, sf_dir).bounding_box("c_nationkey")
    a, b = m.alias("a"), m.alias("b")
    comes = G.box_order(G.vector("hi", 2, "a"), G.vector("lo", 2, "b"))
    return a.join(b, F.col("a.c_nationkey") != F.col("b.c_nationkey")).select(F.col("a.c_nationkey").alias("a"), F.col("b.c_nationkey").alias("b"), comes.alias("comes"))


NEAR = "(greatest(10e0 - x0, x0 - 30e0, 0e0) * greatest(10e0 - x0, x0 - 30e0, 0e0) + greatest(920e0 - x1, x1 - 960e0, 0e0) * greatest(920e0 - x1, x1 - 960e0, 0e0))"


@query(f"WITH {P} SELECT p_partkey, {NEAR} AS md FROM p")
def min_dist(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.df.select("p_partkey", G.min_distance_squared(p.x, *map(G.constants, BOX)).alias("md"))


@query(
    f"WITH {P}, e AS (SELECT p_partkey, x0, x1, CASE WHEN x0 >= 20e0 THEN 10e0 ELSE 30e0 END AS f0, CASE WHEN x0 >= 20e0 THEN 30e0 ELSE 10e0 END AS n0, CASE WHEN x1 >= 940e0 THEN 920e0 ELSE 960e0 END AS f1, CASE WHEN x1 >= 940e0 THEN 960e0 ELSE 920e0 END AS n1 FROM p)"
    " SELECT p_partkey, round(least((x0 - n0) * (x0 - n0) + (x1 - f1) * (x1 - f1), (x0 - f0) * (x0 - f0) + (x1 - n1) * (x1 - n1)), 6) AS mm FROM e"
)
def min_max_dist(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.df.select("p_partkey", F.round(G.min_max_distance_squared(p.x, *map(G.constants, BOX)), 6).alias("mm"))


@query(f"WITH {C} SELECT c_nationkey, (min(x0) + max(x0)) / 2 AS c0, (min(x1) + max(x1)) / 2 AS c1 FROM c GROUP BY 1")
def centroid(spark, sf_dir):
    m = customers(spark, sf_dir).bounding_box("c_nationkey")
    return m.select("c_nationkey", *[x.alias(f"c{i}") for i, x in enumerate(G.centre(G.vector("lo", 2), G.vector("hi", 2)))])


GROWN = "(greatest(x0, hi0) - least(x0, lo0)) * (greatest(x1, hi1) - least(x1, lo1)) - (hi0 - lo0) * (hi1 - lo1)"


@query(f"WITH {C}, m AS (SELECT {MBR} FROM c), s AS (SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) AS x0, CAST(s_suppkey AS DOUBLE) AS x1 FROM supplier) SELECT s_suppkey, {GROWN} AS grown FROM s, m")
def enlargement(spark, sf_dir):
    m = customers(spark, sf_dir).bounding_box()
    s = Points.of(read(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_acctbal", "s_suppkey"])
    return s.df.crossJoin(F.broadcast(m)).select("s_suppkey", G.enlargement(s.x, G.vector("lo", 2), G.vector("hi", 2)).alias("grown"))


@query(f"WITH {L} SELECT " + ", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(4)) + ", count(*) AS n FROM l")
def mbr_global(spark, sf_dir):
    return lines(spark, sf_dir).bounding_box()


@query(f"WITH {C} SELECT c_nationkey, {MBR}, count(*) AS n FROM c GROUP BY 1")
def mbr_by_group(spark, sf_dir):
    return customers(spark, sf_dir).bounding_box("c_nationkey")


@query(f"WITH {C}, m AS (SELECT c_nationkey, {MBR} FROM c GROUP BY 1) SELECT n_regionkey, min(lo0) AS lo0, min(lo1) AS lo1, max(hi0) AS hi0, max(hi1) AS hi1 FROM m JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def mbr_of_mbrs(spark, sf_dir):
    m = customers(spark, sf_dir).bounding_box("c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return m.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(*G.bounds_of_boxes(G.vector("lo", 2), G.vector("hi", 2)))


@query("SELECT s_suppkey, s_acctbal >= 0e0 AND s_acctbal + (s_acctbal - 100e0) >= 0e0 AND s_acctbal + (s_acctbal - 100e0) + 50e0 >= 0e0 AS monotone FROM supplier")
def model_monotone(spark, sf_dir):
    a = F.col("s_acctbal").cast("double")
    return read(spark, sf_dir, "supplier").select("s_suppkey", G.prefix_sums_not_negative(F.array(a, a - F.lit(100.0), F.lit(50.0))).alias("monotone"))


@query(f"WITH {P} SELECT p_partkey, greatest(x1 - 900e0, 0e0) AS h0, greatest(x1 - 930e0, 0e0) AS h1, greatest(x1 - 960e0, 0e0) AS h2 FROM p")
def hinge_rows(spark, sf_dir):
    p = parts(spark, sf_dir)
    h = G.hinges(F.col("x1"), F.array(*G.constants((900.0, 930.0, 960.0))))
    return p.df.select("p_partkey", *[F.element_at(h, i + 1).alias(f"h{i}") for i in range(3)])


@query(f"WITH {P} SELECT p_partkey, x0 >= 10e0 AS c0, x0 >= 20e0 AS c1, x0 >= 40e0 AS c2 FROM p")
def comparison_rows(spark, sf_dir):
    p = parts(spark, sf_dir)
    c = G.comparisons(F.col("x0"), F.array(*G.constants((10.0, 20.0, 40.0))))
    return p.df.select("p_partkey", *[F.element_at(c, i + 1).alias(f"c{i}") for i in range(3)])


@query(f"WITH {P}, {B} SELECT bid, p_partkey, x0, x1 FROM p JOIN b ON x0 BETWEEN lo0 AND hi0 AND x1 BETWEEN lo1 AND hi1")
def box_batch_join(spark, sf_dir):
    p = parts(spark, sf_dir)
    return search.batch_boxes(p, boxes_of(spark, sf_dir)).select("bid", "p_partkey", "x0", "x1")


@query(
    f"WITH {P}, {B}, k AS (SELECT max(d2) AS worst FROM (SELECT {squares(Q2)} AS d2 FROM p ORDER BY d2, p_partkey LIMIT 10)),"
    f" m AS (SELECT bid, greatest(lo0 - {number(Q2[0])}, {number(Q2[0])} - hi0, 0e0) * greatest(lo0 - {number(Q2[0])}, {number(Q2[0])} - hi0, 0e0) + greatest(lo1 - {number(Q2[1])}, {number(Q2[1])} - hi1, 0e0) * greatest(lo1 - {number(Q2[1])}, {number(Q2[1])} - hi1, 0e0) AS md FROM b)"
    " SELECT bid, md FROM m, k WHERE md <= worst"
)
def prune_branches(spark, sf_dir):
    found = search.nearest(parts(spark, sf_dir), Q2, 10)
    return search.prune(search.branch_order(boxes_of(spark, sf_dir), Q2), found, 10).select("bid", "md")
