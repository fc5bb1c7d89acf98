"""Builds an index over points and answers nearest-neighbour queries with it.

python -m lattica.cli [--index grid|kd|rtree] -i POINTS -q QUERIES -o OUT -d INDEX --key pid --coordinates x0,x1
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.box_tree import BoxTree
from lattica.operators.layout import LearnedIndex
from lattica.operators.points import Points
from lattica.sources.store import read_points, save_index, save_tree

KS = (1, 5, 10, 50, 100, 500)


def metrics(costs: Callable[[DataFrame, int], DataFrame], queries: DataFrame, page: str, ks=KS) -> DataFrame:
    """k, queries, avg_pages (pages that a query opens), avg_rows (points that it tests)."""
    out = []
    for k in ks:
        out.append(costs(queries, k).agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("queries"), F.avg(page).alias("avg_pages"), F.avg("tested").alias("avg_rows")))
    return reduce(DataFrame.unionAll, out)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--index", choices=("grid", "kd", "rtree"), default="grid")
    parser.add_argument("-k", action="store_const", const="kd", dest="index", help="the same as --index kd")
    parser.add_argument("-i", "--input", required=True)
    parser.add_argument("-q", "--queries", required=True)
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("-d", "--dump", required=True)
    parser.add_argument("--key", default="pid")
    parser.add_argument("--coordinates", default="x0,x1")
    parser.add_argument("--nearest", type=int, default=10)
    parser.add_argument("--shape", default="")
    parser.add_argument("--leaf", type=int, default=50)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    names = a.coordinates.split(",")
    points = Points.of(read_points(spark, a.input), a.key.split(","), names)
    queries = read_points(spark, a.queries).select("qid", *[F.col(f"q{i}").cast("double").alias(f"q{i}") for i in range(points.d)])
    began = time.time()
    if a.index == "rtree":
        index = BoxTree.build(points, a.leaf)
        save_tree(index, a.dump)
        costs, page = index.nearest_costs, "leaf_pages"
    else:
        shape = tuple(map(int, a.shape.split(","))) if a.shape else (6,) * points.d
        index = LearnedIndex.build(points, shape) if a.index == "grid" else LearnedIndex.build_kd(points, a.leaf)
        save_index(index, a.dump)
        costs, page = index.nearest_costs, "pages"
    built = time.time() - began
    index.nearest(queries, a.nearest).write.mode("overwrite").parquet(f"{a.output}/nearest")
    metrics(costs, queries, page).withColumn("build_seconds", F.lit(built)).coalesce(1).write.mode("overwrite").json(f"{a.output}/metrics")


if __name__ == "__main__":
    main()
