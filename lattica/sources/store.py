"""Indexes on disk: one Parquet folder for each table and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.box_tree import BoxTree
from lattica.operators.grid import Grid
from lattica.operators.layout import LearnedIndex
from lattica.operators.points import Points
from lattica.sources.shared import shuffle_width


def _write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def save_index(index: LearnedIndex, path: str, groups: int = 64) -> None:
    """All tables of an index over grid or KD cells.

    Points lie in folders by cell_group, runs of cells, sorted by mapping: a box reads the folders and row groups it
    needs.
    """
    spark = index.points.sparkSession
    group = F.floor(F.col("cell") * groups / max(1, index.n_cells)).cast("int")
    dealt = index.points.drop("cell_group").withColumn("cell_group", group).repartitionByRange(shuffle_width(spark), "mapping").sortWithinPartitions("mapping")
    dealt.write.mode("overwrite").partitionBy("cell_group").parquet(f"{path}/points")
    for name in ("cells", "models", "parts", "rects"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    grid = {"starts": index.grid.starts, "ends": index.grid.ends} if index.grid else None
    _write_manifest(spark, path, {"kind": "learned", "grid": grid, "key": index.key, "d": index.d, "psi": index.psi, "n_cells": index.n_cells, "groups": groups})


def load_index(spark: SparkSession, path: str) -> LearnedIndex:
    m = _read_manifest(spark, path)
    grid = Grid(tuple(map(tuple, m["grid"]["starts"])), tuple(m["grid"]["ends"])) if m["grid"] else None
    points, cells, models, parts, rects = (spark.read.parquet(f"{path}/{name}") for name in ("points", "cells", "models", "parts", "rects"))
    return LearnedIndex(points, cells, models, parts, rects, tuple(m["key"]), m["d"], m["psi"], m["n_cells"], grid, m["groups"])


def save_tree(tree: BoxTree, path: str) -> None:
    spark = tree.nodes.sparkSession
    tree.points.df.write.mode("overwrite").parquet(f"{path}/points")
    tree.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    _write_manifest(spark, path, {"kind": "tree", "key": tree.points.key, "d": tree.points.d, "capacity": tree.capacity})


def load_tree(spark: SparkSession, path: str) -> BoxTree:
    m = _read_manifest(spark, path)
    return BoxTree(Points(spark.read.parquet(f"{path}/points"), tuple(m["key"]), m["d"]), spark.read.parquet(f"{path}/nodes"), m["capacity"])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with a header, JSON lines or a folder of binary files, by the name's ending."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if path.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if path.endswith("/images"):
        return spark.read.format("binaryFile").load(path)
    return spark.read.parquet(path)


def write_points(points: DataFrame, path: str) -> None:
    """Points, boxes or queries as Parquet, CSV or JSON lines, by the name's ending."""
    out = points.write.mode("overwrite")
    if path.endswith(".csv"):
        out.csv(path, header=True)
    elif path.endswith((".json", ".jsonl")):
        out.json(path)
    else:
        out.parquet(path)


def read_images(spark: SparkSession, path: str, label_bytes: int = 1, side: int = 32) -> DataFrame:
    """number, label and image: the records of binary image batches, each the label's bytes and 3 x side x side pixels, channel by channel.

    Records have one length, so Spark cuts the files without reading any of them as a whole. label is the last of
    its bytes; other formats, such as pickles, are not read, since to unpickle is to run what the file says.
    """
    size = 3 * side * side
    rows = spark.sparkContext.binaryRecords(path, label_bytes + size).map(lambda record: (bytearray(record),))
    values = spark.createDataFrame(rows, "record binary").withColumn("hex", F.hex("record"))
    at = lambda i: F.conv(F.substring("hex", 2 * i + 1, 2), 16, 10).cast("int")
    pixels = F.transform(F.sequence(F.lit(label_bytes), F.lit(label_bytes + size - 1)), lambda i: F.conv(F.substring(F.col("hex"), 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return values.select(at(label_bytes - 1).alias("label") if label_bytes else F.lit(None).cast("int").alias("label"), pixels.alias("image"))
