"""Mixing sources to target weights by subset sums over exact lengths.

Each source gets a word budget. Whole rounds of a source are taken first; for the rest, documents are counted by
exact length, most of the budget is dealt to the lengths in proportion, and a bounded knapsack over what is left
of the counts hits the remainder exactly wherever some subset can. Which documents of a length are taken is
settled by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import slices, small_batches, stash, table

#: Words that the knapsack settles; the rest of a budget is dealt in proportion before.
WINDOW = 1 << 16
#: Hash buckets of the documents of one source and length: only a window over one bucket is ever sorted.
BUCKETS = 4096


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the sum is the largest that is not over the budget.

    A row of bits has the sums that can be made; counts are split into powers of two, so a length with n
    documents costs about log2(n) rows.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    mask, reach = (1 << (budget + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, n = min(count, budget // length) if length else 0, 1
        while left and not reach >> budget & 1:
            n = min(n, left)
            steps.append((i, n, reach))
            reach |= reach << n * length & mask
            left, n = left - n, n * 2
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * lengths[i]
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW) -> list[int]:
    """How many documents of each length make up the budget: proportional shares, then long ones, then the knapsack."""
    total = sum(a * n for a, n in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    bulk = max(0, budget - window)
    taken = [n * bulk // total for n in counts]
    left = budget - sum(a * n for a, n in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left > window and lengths[i]:
            more = min(counts[i] - taken[i], (left - window) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    more = knapsack(lengths, [n - m for n, m in zip(counts, taken, strict=True)], left)
    return [n + m for n, m in zip(taken, more, strict=True)]


def word_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size (runs other than ASCII white space in the text; null: 0) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = [len((x or "").encode().split()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "size"])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(F.col(key), F.col(source).cast("string"), F.col(text).cast("string")).mapInArrow(run, f"doc_id {kind}, source string, size bigint")


def share_out(sizes: list[int], weights: list[float], limit: int = 3) -> list[float]:
    """Targets by weight, none over limit times its size; the excess goes to the others by weight until none is over."""
    targets = [0.0] * len(sizes)
    left, free = float(sum(sizes)), list(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > limit * sizes[i]]
        if not over:
            for i in free:
                targets[i] = unit * weights[i]
            break
        for i in over:
            targets[i] = float(limit * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(over)]
    return targets


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, take the weights in turn.

    The table has one row for each source. Targets come from rounds of sums over it: whoever is over its limit
    is fixed there, and what is left is shared again, until nobody is; nothing but two sums reaches the driver.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    listed = stash(sums.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1).alias("weight")), "sources")
    cap = F.lit(limit) * F.col("source_size")
    unit, fixed = None, -1
    while True:
        over = F.lit(False) if unit is None else F.lit(unit) * F.col("weight") > cap
        row = listed.select(F.sum("source_size").alias("all"), F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if row["all"] is None or row["n"] == fixed:
            break
        fixed = row["n"]
        if row["free"] is None:
            unit = float("inf")
            break
        unit = (row["all"] - float(row["capped"] or 0)) / row["free"]
    share = F.lit(0.0 if unit is None else unit) * F.col("weight")
    return listed.select("source", "source_size", F.least(share, cap.cast("double")).alias("target"))


def mix(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target and times: how often the mix takes the document (0 to limit).

    sized has doc_id, source and size, as word_sizes() gives them. Documents of no words are taken as often as
    their source is repeated as a whole; they don't count. A null source is a source. Rows that repeat an id
    are documents of their own; which of two alike rows is taken makes no difference. Nothing depends on how
    rows are dealt to tasks, so reruns agree. An empty table gives no rows.
    """
    sized = sized.select("doc_id", "source", "size")
    targets = source_targets(sized, weights, limit)
    hashed = sized.withColumn("h", F.xxhash64("doc_id", "source", "size", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    counts = hashed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    planned = lengths.join(targets, lengths["source"].eqNullSafe(targets["source"])).select(lengths["source"], "size", "n", "source_size", "target")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        """One source: a row for each length that it has, however many documents there are."""
        group = group.sort_values("size")
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = min(limit, int(target // whole)) if whole else 0
        budget = min(whole, round(target - rounds * whole)) if rounds < limit else 0
        take = fit_budget(group["size"].tolist(), group["n"].tolist(), budget)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "source_size": whole, "target": target, "rounds": rounds, "take": np.array(take, np.int64)})

    plans = planned.groupBy("source").applyInPandas(plan, "source string, size bigint, source_size bigint, target double, rounds int, take bigint")
    by_length = W.partitionBy("source", "size").orderBy("bucket")
    ranges = counts.withColumn("before", F.sum("n").over(by_length) - F.col("n")).alias("c")
    p = plans.alias("p")
    ranges = ranges.join(p, F.col("c.source").eqNullSafe(F.col("p.source")) & (F.col("c.size") == F.col("p.size"))).select("c.source", "c.size", "c.bucket", "c.before", "p.source_size", "p.target", "p.rounds", "p.take")
    ranked = hashed.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("h", "doc_id"))).alias("d")
    r = ranges.alias("r")
    on = F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.size") == F.col("r.size")) & (F.col("d.bucket") == F.col("r.bucket"))
    chosen = (F.col("r.before") + F.col("d.rank") <= F.col("r.take")).cast("int")
    return ranked.join(r, on).select("d.doc_id", "d.source", "d.size", "r.source_size", "r.target", (F.col("r.rounds") + chosen).alias("times"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stash(word_sizes(table(spark, sf_dir, "documents")), "sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
