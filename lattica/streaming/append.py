"""Growing indexes from streams: each micro-batch is inserted into the tree and saved as its next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from lattica.operators.box_tree import CAPACITY, BoxTree
from lattica.operators.points import Points
from lattica.sources.store import load_tree, save_tree


def version_path(path: str, version: int) -> str:
    return f"{path}/v{version:06d}"


def append_stream(stream: DataFrame, path: str, key: Sequence[str], coordinates: Sequence[Column | str], checkpoint: str, capacity: int = CAPACITY) -> StreamingQuery:
    """Starts a query that keeps a box tree in path/v000000, path/v000001, ... .

    A version is named after its batch and made from the one before it, so a batch that is run again after a
    failure makes the same version again. The stream's rows are points; no watermark is needed.
    """

    def insert(batch: DataFrame, number: int) -> None:
        points = Points.of(batch, key, coordinates)
        spark = batch.sparkSession
        if number == 0:
            tree = BoxTree.build(points, capacity)
        else:
            tree = load_tree(spark, version_path(path, number - 1)).insert(points)
        save_tree(tree, version_path(path, number))

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).start()
