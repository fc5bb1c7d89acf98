"""Exact top-k search by tiled matrix products, partial selection in each tile and a tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.llm.tiles import Chunk, by_length, dealt, finite, narrowed, search, stacked, vectors


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats, doubles or longs where every sum fits, else in Python's integers, held to a long's range."""
    most = q.shape[1]
    for x in (q, c):
        most *= max(1, -int(x.min(initial=0)), int(x.max(initial=0)))
    for bits, kind in ((24, np.float32), (53, np.float64), (63, np.int64)):
        if most < 1 << bits:
            return q.astype(kind, copy=False) @ c.T.astype(kind, copy=False)
    big, (q, c) = (1 << 63) - 1, (x.astype(np.int64).tolist() for x in (q, c))
    return np.array([[max(-big, min(big, sum(a * b for a, b in zip(x, y, strict=True)))) for y in c] for x in q], np.int64).reshape(len(q), len(c))


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with vectors of its length, itself left out.

    Both tables have vec_id (bigint, not null) and v (array<bigint>, finite); other columns are left out. Ties go
    to the smaller vec_id. Rows alike in id and vector count once; of rows that share an id and differ, each is a
    query and a candidate, but for queries of that id. Null or empty vectors and null ids take no part; an empty
    table gives no rows. Scores beyond a long are held to its range.
    """
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)

    def read(batch: pa.RecordBatch) -> Chunk:
        # Rows alike are one.
        _, new = np.unique(batch.column("row").to_numpy(), return_index=True)
        batch = batch.take(pa.array(new))
        ids, (lengths, values) = batch.column("vec_id").to_numpy(), vectors(batch.column("v"))
        # Floats hold small integers exactly, and need not be made again for each product.
        values = narrowed(values)
        values = values.astype(np.float32) if values.dtype == np.int16 else values
        groups = {n: (rows, stacked(lengths, values, rows, n)) for n, rows in by_length(lengths).items()}
        return Chunk(ids, ids, np.ones(len(ids), bool), batch.column("row").to_numpy(), groups)

    asked = queries.where(good).select("vec_id", "v", F.xxhash64("v").alias("qkey"))
    rows = candidates.where(good).select("vec_id", "v", F.xxhash64("vec_id", "v").alias("row"))
    blocks = dealt(asked)
    lists = search(blocks, rows, read, lambda q, c: np.negative(found := products(c, q), out=found), "bigint", k)
    for block in blocks:
        block.destroy()
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "found"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.key")).alias("score"))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    return exact_top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
