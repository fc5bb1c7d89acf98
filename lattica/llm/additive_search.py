"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one full-dimensional codeword from each of several codebooks. Codebooks are
fitted to residuals, one after another, on a bounded sample; every row is then encoded by a beam search and
stored with the norm of its sum. A query makes one table of its products with all codewords; looked up by code,
with the stored norm, it gives the distance to every sum. Only codes and norms are streamed past the queries; the best
few of all are joined with their vectors, each vector once for all queries of a block, and ranked again by the true
distance, so every score is exact. The index has each distinct vector once, with the smallest ids of its copies, which
therefore stand and fall together. Nothing is fitted or ranked by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import small_batches, stash, table
from lattica.llm.tiles import Chunk, by_length, dealt, finite, search, stacked, vectors
from lattica.sources.shared import forget_shuffles

#: Rows that codebooks are fitted on, at most.
SAMPLE = 16_384
#: Codebooks, codewords of each, sums that a beam keeps, rounds of k-means.
BOOKS, WORDS, BEAM, ROUNDS = 24, 256, 2, 8
#: Of each query, the distinct vectors that are ranked again by true distance (k, if that is more).
RERANK = 256
#: Ids of a vector's copies that the index keeps: enough for as many nearest.
MOST = 64
#: Codes that are looked up, and pairs that are measured, at a time.
LOOKUP, PAIRS = 1024, 16_384


@dataclass
class Codebooks:
    """books: codebook, codeword, component. Vectors of other lengths have no codes."""

    books: np.ndarray

    @property
    def dim(self) -> int:
        return self.books.shape[2]

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 7) -> Codebooks:
        draw, left, found = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        for _ in range(books):
            words_now = left[draw.permutation(len(left))[:words]].copy()
            if len(words_now) < words:
                words_now = np.vstack([words_now, np.zeros((words - len(words_now), x.shape[1]), np.float32)])
            for _ in range(rounds):
                near = cls.nearest(left, words_now)
                sums, n = np.zeros_like(words_now), np.bincount(near, minlength=words)
                np.add.at(sums, near, left)
                words_now = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words_now).astype(np.float32)
            left -= words_now[cls.nearest(left, words_now)]
            found.append(words_now)
        return cls(np.stack(found))

    @staticmethod
    def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        half = (words**2).sum(1) / 2
        return np.concatenate([np.argmin(half - x[i : i + 4096] @ words.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (a byte for each codebook) and squared norms of the sums, by beam search over residuals."""
        n = len(x)
        left, codes, at = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8), np.arange(n)[:, None]
        for words in self.books:
            # |r - c|^2 for every kept residual and codeword
            cost = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, x.shape[1]) @ words.T).reshape(n, -1, len(words)) + (words**2).sum(1)
            flat = cost.reshape(n, -1)
            best = np.argpartition(flat, beam - 1, axis=1)[:, :beam]
            parent, word = np.divmod(best, len(words))
            left = left[at, parent] - words[word]
            codes = np.concatenate([codes[at, parent], word[:, :, None].astype(np.uint8)], axis=2)
        best = np.argmin((left**2).sum(2), axis=1)
        rows = np.arange(n)
        return codes[rows, best], ((x - left[rows, best]) ** 2).sum(1).astype(np.float32)

    def approximate(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Squared distances to the sums, but for the query's own norm: table lookups and the stored norms."""
        books, words, dim = self.books.shape
        tables = (self.books.reshape(-1, dim) @ (-2 * queries.astype(np.float32)).T).reshape(books, words, -1)
        found = np.repeat(norms[:, None], len(queries), axis=1)
        looked_up = np.empty((min(LOOKUP, len(norms)), len(queries)), np.float32)
        for start in range(0, len(norms), LOOKUP):
            part = found[start : start + LOOKUP]
            for table, own in zip(tables, codes[start : start + LOOKUP].T, strict=True):
                part += np.take(table, own, axis=0, out=looked_up[: len(part)], mode="clip")
        return found.T


#: The columns of a vector: as floats where they are exactly its components, else as doubles.
VECTOR = ("v32", "v64")


def halved(v: Column) -> list[Column]:
    """VECTOR of an array of doubles."""
    exact = F.forall(v, lambda x: x.cast("float").cast("double") == x)
    return [F.when(exact, v.cast("array<float>")).alias("v32"), F.when(exact, F.lit(None)).otherwise(v).alias("v64")]


def doubles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values, as vectors() gives them, of the columns VECTOR."""
    v32, v64 = (batch.column(name).cast(pa.list_(pa.float64())) for name in VECTOR)
    return vectors(pc.coalesce(v32, v64) if v64.null_count < len(v64) else v32)


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE) -> Codebooks:
    """Fits on the rows of the smallest hashed ids, of the commonest length among them, in one task, which holds no more than these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [vectors(batch.column(0)) for batch in batches if batch.num_rows]
        if parts:
            lengths, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            groups = by_length(lengths)
            n = max(groups, key=lambda n: (len(groups[n]), n))
            books = Codebooks.fit(stacked(lengths, values, groups[n], n)).books
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([books.tobytes()])], names=["n", "books"])

    place = F.xxhash64("vec_id")
    # Rows beyond this hash would only be sorted away. Where ids are so dealt that too few are left, all are taken.
    share = 1.2 * sample / max(1, rows.count())
    some = rows.where(place < int((2 * share - 1) * 2**63)) if share < 1 else rows
    if share < 1 and some.count() < sample:
        some = rows
    first = small_batches(some.select("vec_id", "v").orderBy(place, "vec_id").limit(sample).select("v").coalesce(1))
    found = first.mapInArrow(run, "n int, books binary").first()
    if found is None:
        return Codebooks(np.zeros((BOOKS, WORDS, 1), np.float32))
    return Codebooks(np.frombuffer(found["books"], np.float32).reshape(-1, WORDS, found["n"]))


def build_index(rows: DataFrame, model: Codebooks, most: int = MOST) -> DataFrame:
    """vid, ids, v32, v64, code, norm for every distinct vector: its hash, its most + 1 smallest ids, VECTOR, its code and norm.

    code is null where the vector's length is not the codebooks'. Only as many ids of a vector are ever shuffled from
    a task, so a vector with any number of copies is no burden.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                lengths, values = doubles(batch)
                codes, norms = [None] * len(lengths), np.zeros(len(lengths), np.float32)
                own = np.flatnonzero(lengths == model.dim)
                if len(own):
                    found, norms[own] = model.encode(stacked(lengths, values, own, model.dim))
                    for i, code in zip(own, found, strict=True):
                        codes[i] = code.tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(norms)], names=["vid", "ids", *VECTOR, "code", "norm"])

    good = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    # Zeros of either sign are alike: a zero is added to all.
    named = good.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("vid", F.xxhash64("v"))
    place = F.row_number().over(W.partitionBy("vid").orderBy("vec_id"))
    members = named.select("vid", "vec_id").distinct().withColumn("place", place).where(F.col("place") <= most + 1)
    ids = members.groupBy("vid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    each = named.select("vid", F.struct(*halved(F.col("v"))).alias("v")).groupBy("vid").agg(F.first("v").alias("v"))
    whole = small_batches(each.join(ids, "vid").select("vid", "ids", "v.*"))
    return whole.mapInArrow(run, "vid bigint, ids array<bigint>, v32 array<float>, v64 array<double>, code binary, norm float")


def read_codes(model: Codebooks):
    """A batch of vid, only, code and norm as a Chunk."""

    def read(batch: pa.RecordBatch) -> Chunk:
        own, n = batch.column("only"), batch.num_rows
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, -1)
        codes = codes.T.astype(np.intp, order="C").T
        barred = own.is_valid().to_numpy(zero_copy_only=False)
        groups = {model.dim: (np.arange(n), (codes, batch.column("norm").to_numpy()))}
        return Chunk(batch.column("vid").to_numpy(), own.fill_null(0).to_numpy(), barred, None, groups)

    return read


def read_bare(batch: pa.RecordBatch) -> Chunk:
    """A batch of vid, only and VECTOR as a Chunk."""
    own, (lengths, values) = batch.column("only"), doubles(batch)
    groups = {n: (rows, stacked(lengths, values, rows, n)) for n, rows in by_length(lengths).items()}
    return Chunk(batch.column("vid").to_numpy(), own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False), None, groups)


def distances(q: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared, a row for each of the others."""
    return np.stack([((others - x) ** 2).sum(1) for x in q.astype(np.float64)], axis=1)


def without_nan(far: np.ndarray) -> np.ndarray:
    """The same array, where what is not a number is infinitely far."""
    if np.isnan(far.min(initial=0)):
        far[np.isnan(far)] = np.inf
    return far


def measured(wanted: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """query_id, block, at, ids and score, of rows of a vector, a block and the places of its queries in it: the Euclidean distance, in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values = doubles(batch)
            of_block = batch.column("block").to_numpy()
            sizes, places = vectors(batch.column("places"))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            for number in np.unique(of_block):
                block, own = blocks[number].value, of_block[row] == number
                rows, at = row[own], places[own]
                for start in range(0, len(rows), PAIRS):
                    r, p = rows[start : start + PAIRS], at[start : start + PAIRS]
                    score = np.empty(len(r))
                    for n, some in by_length(lengths[r]).items():
                        score[some] = np.sqrt(((stacked(lengths, values, r[some], n) - block.of(p[some], n)) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[p]), pa.array(np.full(len(p), number, np.int32)), pa.array(p), batch.column("ids").take(pa.array(r)), pa.array(score)], names=["query_id", "block", "at", "ids", "score"])

    # A task has one block at a time.
    rows = small_batches(wanted if len(blocks) == 1 else wanted.sortWithinPartitions("block"))
    return rows.select("block", "places", "ids", *VECTOR).mapInArrow(run, "query_id bigint, block int, at int, ids array<bigint>, score double")


def nearest(queries: DataFrame, index: DataFrame, model: Codebooks, k: int, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in doubles): each query's k nearest found, itself left out.

    index is build_index()'s, written or cached, with at least k ids of a vector. Ties go to the smaller vec_id. Rows
    alike in id and vector count once. Vectors are compared with those of their own length; those without codes are
    all compared exactly. Null ids and null or empty vectors take no part; an empty table gives no rows.
    """
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    blocks = dealt(queries.where(good).select("vec_id", "v", F.xxhash64("v").alias("qkey")))
    # Vectors that only the query's own id has would take places and be left out in the end.
    keep, only = max(rerank, k), F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("only")
    coded, bare = (index.where(x).select("vid", only, *columns) for x, columns in (("code is not null", ("code", "norm")), ("code is null", VECTOR)))
    lists = search(blocks, coded, read_codes(model), lambda q, x: without_nan(model.approximate(q, *x).T), "float", keep)
    found = lists.select("block", "at", F.explode("top.vec_id").alias("vid"))
    if bare.limit(1).count():
        lists = search(blocks, bare, read_bare, lambda q, x: without_nan(distances(q, x)), "double", keep)
        found = found.unionAll(lists.select("block", "at", F.explode("top.vec_id").alias("vid")))
    wanted = found.repartition("vid").groupBy("vid", "block").agg(F.collect_list("at").alias("places"))
    each = measured(wanted.join(index.select("vid", F.slice("ids", 1, k + 1).alias("ids"), *VECTOR), "vid"), blocks)
    each = each.withColumn("ids", F.filter("ids", lambda x: x != F.col("query_id"))).where(F.size("ids") > 0)
    # The k nearest ids are all of the k nearest vectors, each at its smallest id.
    query = W.partitionBy("block", "at")
    first = F.row_number().over(query.orderBy("score", F.get("ids", F.lit(0))))
    each = each.withColumn("first", first).where(F.col("first") <= k).select("query_id", "block", "at", F.explode("ids").alias("vec_id"), "score")
    ranked = each.withColumn("rank", F.row_number().over(query.orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    result = stash(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    for block in blocks:
        block.destroy()
    return result


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    model = fit_codebooks(rows)
    index = stash(build_index(rows, model), "additive-index")
    forget_shuffles(spark)
    return nearest(rows.where(F.col("vec_id") % 100 == 0), index, model, 10)
