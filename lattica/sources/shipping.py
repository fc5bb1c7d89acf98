"""Sends this package to the executors, which then need no copy of the repository on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


@functools.lru_cache(1)
def package_zip() -> str:
    """A zip file of the package's modules."""
    path = os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    return path


def ship(spark: SparkSession) -> None:
    """Once for each context."""
    context = spark.sparkContext
    if getattr(context, "_lattica_shipped", None) is None:
        context.addPyFile(package_zip())
        context._lattica_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after the package has been sent."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
