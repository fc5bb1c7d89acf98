"""The folder that driver and executors share, and tables written there in the middle of a plan."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="lattica-")
    spark.sparkContext.setCheckpointDir(path)
    return f"file://{path}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df to the shared folder and reads it back: later steps don't depend on executors that made it."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of plans that are done and not held: it does when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that stash() wrote; for when no result that was made of them is read again."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a side of a join is sent to all tasks.
BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has no more than this many rows; no more than these are counted."""
    return df.limit(rows + 1).count() <= rows


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, for an equi-join: with a broadcast hint if it has no more than this many rows, else Spark shuffles both sides."""
    return F.broadcast(df) if is_small(df, rows) else df


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], spread: Sequence[str], salts: int = 8, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with a table that has a few rows for each key: sent to all tasks if small.

    Else both sides are shuffled, with every key split into `salts` by a hash of the columns `spread` of rows, so
    that a key of very many rows isn't one task's work.
    """
    if is_small(table, limit):
        return rows.join(F.broadcast(table), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"]).drop("_salt")


def split_sides(points: DataFrame, asked: DataFrame, on: list[str], sizes: DataFrame, key: Sequence[str], rows: int = 50_000, piece: str = "_piece") -> tuple[DataFrame, DataFrame, list[str]]:
    """points, what asks for their groups, and the columns that they meet by: groups of more than `rows` points in several pieces.

    sizes: the columns `on` and n, the points of each group. A large group's points are dealt to pieces by a hash of
    their key, and every request for it goes to each of its pieces. There are at most N / rows such groups.
    """
    heavy = sizes.where(F.col("n") > rows).select(*on, F.ceil(F.col("n") / rows).cast("int").alias("_pieces"))
    if not heavy.limit(1).count():
        return points, asked, list(on)
    heavy = bounded_broadcast(heavy)
    own = F.when(F.col("_pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*key), F.col("_pieces")).cast("int"))
    dealt = points.join(heavy, on, "left").withColumn(piece, own).drop("_pieces")
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1)
    copies = asked.join(heavy, on, "left").withColumn(piece, F.explode(pieces)).drop("_pieces")
    return dealt, copies, [*on, piece]


def split_join(points: DataFrame, asked: DataFrame, on: list[str], sizes: DataFrame, key: Sequence[str], rows: int = 50_000) -> DataFrame:
    """points joined with what asks for their groups, groups of more than `rows` points in several pieces."""
    dealt, copies, by = split_sides(points, asked, on, sizes, key, rows)
    return dealt.join(copies, by).drop("_piece")
