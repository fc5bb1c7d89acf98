"""Box, radius, nearest-neighbour and lookup queries; every answer equals a full scan's."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cmp_to_key, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lattica.functions.geometry import all_of, constants, distance_squared, in_box, min_distance_squared, min_max_distance_squared, vector
from lattica.operators.grid import Grid
from lattica.operators.points import Points
from lattica.plans.descend import hierarchy, near_nodes
from lattica.sources.shared import BROADCAST_ROWS, is_small, shuffle_width, split_join, split_sides, stash

#: Queries of a block, pairs of query and neighbour that a task gives at a time, points that it takes at a time.
QUERY_BLOCK, PAIR_ROWS, SCAN_ROWS = 20_000, 1_000_000, 65_536
#: Points of a cell where boxes and points meet by cell.
CELL_ROWS = 10_000


def in_rectangle(points: DataFrame, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Points of a closed box. On stored points the ranges reach the Parquet scan."""
    return points.where(in_box(vector("x", len(lo)), constants(lo), constants(hi)))


def at_point(points: DataFrame, p: Sequence[float]) -> DataFrame:
    """All points with exactly these coordinates."""
    return points.where(all_of([x == v for x, v in zip(vector("x", len(p)), constants(p), strict=True)]))


def within(points: DataFrame, q: Sequence[float], radius: float) -> DataFrame:
    """Points no farther than radius, with d2; the box around the ball is tested first."""
    box = in_rectangle(points, [v - radius for v in q], [v + radius for v in q])
    return box.withColumn("d2", distance_squared(vector("x", len(q)), constants(q))).where(F.col("d2") <= F.lit(float(radius) * float(radius)))


def nearest(points: Points, q: Sequence[float], k: int) -> DataFrame:
    """The k nearest points of one query with d2 and rn, ties by the key. Partial top-k in each task."""
    near = points.df.withColumn("d2", distance_squared(points.x, constants(q))).orderBy("d2", *points.key).limit(k)
    return near.withColumn("rn", F.row_number().over(W.orderBy("d2", *points.key)))


def expanding_radius(points: Points, q: Sequence[float], k: int, start: float) -> DataFrame:
    """The k nearest by balls of doubling radius from start, which must be over 0; ends when k points are found or the ball holds them all.

    No step returns rows to the driver but a count.
    """
    if not start > 0:
        raise ValueError("the first radius must be over 0")
    total, radius = points.df.count(), start
    while (found := within(points.df, q, radius)).limit(k).count() < min(k, total):
        radius *= 2
    return found.withColumn("rn", F.row_number().over(W.orderBy("d2", *points.key))).where(F.col("rn") <= k)


def batch_boxes(points: Points, boxes: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Each box with each of its points. boxes: bid, lo0.., hi0.. .

    Up to `limit` boxes are sent to the points. More are dealt with the points to the cells of a grid, and join by cell.
    """
    inside = in_box(points.x, vector("lo", points.d), vector("hi", points.d))
    if is_small(boxes, limit):
        return points.df.join(F.broadcast(boxes), inside)
    chunks = max(2, round((points.df.count() / CELL_ROWS) ** (1 / points.d)))
    grid = Grid.fit(points, (chunks,) * points.d)
    placed = grid.place(points).drop("mapping", *[f"i{i}" for i in range(points.d)])
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return split_join(placed, grid.cells_of(boxes), ["cell"], sizes, points.key).where(inside).drop("cell")


def top_k(df: DataFrame, query: str, key: Sequence[str], k: int | Column) -> DataFrame:
    """The k rows of least d2 for each query, with rn; only k rows of a query and task are shuffled if k is a number."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(query).orderBy("d2", *key))).where(F.col("rn") <= k)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as the session shuffles into: a small file is one partition, and one core's work."""
    width = shuffle_width(df.sparkSession)
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= width else df.repartition(width)


def _nearest_of(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of q the places in x of its k nearest, ties to the earlier place: rows of q, places, squared distances."""
    found = []
    step = max(1, (4 << 20) // max(1, len(x)))
    for start in range(0, len(q), step):
        d2 = np.zeros((len(q[start : start + step]), len(x)))
        for j in range(x.shape[1]):
            gap = x[None, :, j] - q[start : start + step, None, j]
            d2 += gap * gap
        if len(x) > k:
            cut = np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
            row, place = np.nonzero(~(d2 > cut))  # also where d2 is NaN, which comes last
        else:
            row, place = (v.ravel() for v in np.indices(d2.shape))
        far = d2[row, place]
        order = np.lexsort((place, far, row))
        row, place, far = row[order], place[order], far[order]
        among = np.arange(len(row)) - np.searchsorted(row, row)
        best = among < k
        found.append((row[best] + start, place[best], far[best]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def batch_nearest(points: Points, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k nearest by a full scan: qid, the key, x0.., d2 and rn. queries: qid, q0.. .

    Blocks of at most some `block` queries are sent to the points, which they meet in matrices of bounded size; of
    each, only k points of a query go on. More queries are more blocks, each a scan: past a few blocks use an index.
    """
    names, axes = [*points.key, *[f"x{i}" for i in range(points.d)]], [f"q{i}" for i in range(points.d)]
    n = queries.count()
    blocks = max(1, -(-n // max(1, min(block, PAIR_ROWS // k))))
    df = spread(points.df.select(*names)).sortWithinPartitions(*points.key)
    kinds = {f.name: f.dataType for f in (*queries.schema.fields, *df.schema.fields)}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in ("qid", *names)) + ", d2 double"
    lists = []
    for number in range(blocks):
        own = queries.select("qid", *axes).where(F.pmod(F.xxhash64("qid", *axes), F.lit(blocks)) == number).toArrow()
        ids, q = own.column("qid").combine_chunks(), np.stack([own.column(c).to_numpy() for c in axes], 1)
        if not len(ids):
            continue

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            def one(part: pa.Table) -> Iterator[pa.RecordBatch]:
                x = np.stack([part.column(f"x{i}").to_numpy() for i in range(q.shape[1])], 1)
                row, place, far = _nearest_of(x, q, k)
                kept = part.take(pa.array(place))
                columns = [ids.take(pa.array(row)), *kept.columns, pa.array(far)]
                yield from pa.table(columns, names=["qid", *part.column_names, "d2"]).to_batches(65536)

            held, rows = [], 0
            for batch in batches:
                held.append(batch)
                rows += batch.num_rows
                if rows >= max(SCAN_ROWS, len(q) * k):
                    yield from one(pa.Table.from_batches(held))
                    held, rows = [], 0
            if rows:
                yield from one(pa.Table.from_batches(held))

        lists.append(df.mapInArrow(run, schema))
    if not lists:
        return queries.select("qid").limit(0).crossJoin(points.df.select(*names).limit(0)).withColumn("d2", F.lit(0.0)).withColumn("rn", F.lit(0))
    return top_k(reduce(DataFrame.unionAll, lists), "qid", points.key, k)


def nearest_in_groups(points: Points, near: DataFrame, k: int, on: list[str], sizes: DataFrame) -> DataFrame:
    """Each query's k nearest among the groups that it asks for: the points' columns, qid, q0.., d2 and rn.

    near: qid, q0.. and the columns `on` of a group; sizes: `on` and n, the points of each group. A group's queries
    meet its points in one task, in matrices of bounded size, and only k points of each query go on: the pairs, which
    grow with both tables, are never rows. Groups of many points or queries are cut into pieces that all meet.
    """
    axes = [f"q{i}" for i in range(points.d)]
    near = stash(near.select("qid", *axes, *on), "near")
    asked = near.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    dealt, copies, first = split_sides(points.df, near, on, sizes, points.key)
    copies, dealt, second = split_sides(copies, dealt, on, asked, ["qid"], max(1, min(QUERY_BLOCK, PAIR_ROWS // k)), "_block")
    by = [*first, *second[len(on) :]]
    names, order = points.df.columns, [(c, "ascending") for c in points.key]

    def one(rows: pa.Table, asking: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start")).select(names)
        x = np.stack([rows.column(f"x{i}").to_numpy() for i in range(len(axes))], 1).reshape(-1, len(axes))
        q = np.stack([asking.column(c).to_numpy().astype(float) for c in axes], 1).reshape(-1, len(axes))
        unknown = np.isnan(q).any(1)  # nulls: no box is near to a NaN
        row, place, far = _nearest_of(x, q, k) if len(x) and len(q) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        asking, found = asking.select(["qid", *axes]).take(pa.array(row)), rows.take(pa.array(place))
        return pa.table([*found.columns, *asking.columns, pa.array(far, mask=unknown[row])], names=[*names, "qid", *axes, "d2"])

    schema = StructType([*points.df.schema.fields, *near.select("qid", *axes).schema.fields, StructField("d2", DoubleType())])
    return top_k(dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(one, schema), "qid", points.key, k)


def candidate_cells(cells: DataFrame, queries: DataFrame, k: int, d: int, cell: str = "cell", fans: Sequence[int] | None = None) -> DataFrame:
    """qid, q0.., cell, md: for each query the cells that can hold one of its k nearest, found by descent.

    cells: cell (a number), lo0.., hi0.. (bounds of the points in it) and n.
    """
    return near_nodes(queries, hierarchy(cells, d, cell, fans), k, d).withColumnRenamed("node", cell)


def indexed_nearest(points: Points, cells: DataFrame, queries: DataFrame, k: int, cell: str = "cell", levels: Sequence[DataFrame] | None = None) -> DataFrame:
    """Each query's k nearest, from the points of its candidate cells alone. points.df has the cell.

    levels: a hierarchy that ends in the cells, where there is one already.
    """
    candidates = near_nodes(queries, levels or hierarchy(cells, points.d, cell), k, points.d).withColumnRenamed("node", cell)
    pairs = split_join(points.df, candidates, [cell], cells.select(cell, "n"), points.key)
    return top_k(pairs.withColumn("d2", distance_squared(points.x, vector("q", points.d))), "qid", points.key, k)


def branch_order(cells: DataFrame, q: Sequence[float], by: str = "min") -> DataFrame:
    """Boxes with md (MINDIST squared) and mm (MINMAXDIST squared), in ascending order of one of them ('min' or 'minmax')."""
    d = len(q)
    p, lo, hi = constants(q), vector("lo", d), vector("hi", d)
    df = cells.withColumn("md", min_distance_squared(p, lo, hi)).withColumn("mm", min_max_distance_squared(p, lo, hi))
    return df.orderBy("md" if by == "min" else "mm")


def batch_branch_order(queries: DataFrame, boxes: DataFrame, d: int, by: str = "min") -> DataFrame:
    """qid, bid, md, mm, place: for each query all boxes, few enough to be sent to the queries, in the order of md or mm."""
    if not is_small(boxes):
        raise ValueError("for many boxes come down a hierarchy of them")
    q, lo, hi = vector("q", d), vector("lo", d), vector("hi", d)
    pairs = queries.crossJoin(F.broadcast(boxes)).withColumn("md", min_distance_squared(q, lo, hi)).withColumn("mm", min_max_distance_squared(q, lo, hi))
    return pairs.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy("md" if by == "min" else "mm", "bid")))


def in_box_order(boxes: DataFrame, d: int) -> DataFrame:
    """boxes with place, from 0: sorted by box_order() of two at a time, on the driver, which takes BROADCAST_ROWS at most.

    A box comes after another if it does not reach beyond that one's lower corner: where boxes lie along each
    other this is an order; elsewhere pairs may contradict each other, and the place depends on the input's order.
    """
    if not is_small(boxes):
        raise ValueError("too many boxes to be compared on the driver")
    rows = boxes.collect()

    def compare(a, b) -> int:
        reaches = all(a[f"hi{i}"] > b[f"lo{i}"] for i in range(d))
        back = all(b[f"hi{i}"] > a[f"lo{i}"] for i in range(d))
        return 0 if reaches == back else 1 if reaches else -1

    ordered = sorted(rows, key=cmp_to_key(compare))
    schema = StructType([*boxes.schema.fields, StructField("place", LongType())])
    return boxes.sparkSession.createDataFrame([(*row, i) for i, row in enumerate(ordered)], schema)


def prune(branches: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Branches that may still hold a nearest point: all, until found has k rows; then those not beyond its largest d2."""
    worst = found.agg(F.count(F.lit(1)).alias("_n"), F.max("d2").alias("_worst"))
    return branches.crossJoin(F.broadcast(worst)).where((F.col("_n") < k) | (F.col("md") <= F.col("_worst"))).drop("_n", "_worst")


def pages_touched(points: DataFrame) -> DataFrame:
    """rows and distinct pages of a selection of a learned layout."""
    return points.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("part", "shard", "page").alias("pages"))
