"""The learned layout: partitions of the mapping, models, shards and pages, and the searches that go through them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.geometry import boxes_overlap, bounds, constants, in_box, vector
from lattica.operators.grid import Grid
from lattica.operators.kd_cells import kd_cells, kd_nodes
from lattica.operators.points import Points
from lattica.operators.rank_model import predicted, shards_between, train
from lattica.operators.ranking import equal_parts, global_rank
from lattica.plans.descend import hierarchy, met_nodes, near_nodes
from lattica.plans.search import nearest_in_groups
from lattica.sources.shared import bounded_broadcast, salted_join, split_join, stash

#: Points of a partition, where their number isn't given; and of those partitions at least.
PART_ROWS, PARTS = 50_000, 10


def partitioned(placed: DataFrame, key: tuple[str, ...], parts: int) -> DataFrame:
    """placed with its global rank by mapping, its part and its rank within the part, from 0."""
    return equal_parts(global_rank(placed, ["mapping", *key], "global_rank"), parts, "global_rank", within="rank")


def partition_bounds(ranked: DataFrame) -> DataFrame:
    """part, m_lo, m_hi, n."""
    return ranked.groupBy("part").agg(F.min("mapping").alias("m_lo"), F.max("mapping").alias("m_hi"), F.count(F.lit(1)).alias("n"))


def sharded(ranked: DataFrame, models: DataFrame, key: tuple[str, ...], psi: int) -> DataFrame:
    """ranked with the model's f, its shard and its page of psi rows within the shard. There is one model for each part."""
    df = ranked.join(bounded_broadcast(models.select("part", "alpha", "beta")), "part")
    df = df.withColumn("f", predicted(F.col("mapping"), F.col("alpha"), F.col("beta"))).drop("alpha", "beta")
    df = df.withColumn("shard", F.floor(F.col("f") / F.lit(float(psi))).cast("long"))
    return paged(df, key, psi)


def paged(df: DataFrame, key: tuple[str, ...], psi: int) -> DataFrame:
    """df with page: runs of psi rows of a shard, in the order of the mapping. A shard has no more rows than its part."""
    place = F.row_number().over(W.partitionBy("part", "shard").orderBy("mapping", *key)) - 1
    return df.withColumn("page", F.floor(place / psi).cast("long"))


def page(df: DataFrame, part: int, shard: int, number: int) -> DataFrame:
    """The rows of one page."""
    return df.where((F.col("part") == part) & (F.col("shard") == shard) & (F.col("page") == number))


def shard_bounds(df: DataFrame, d: int) -> DataFrame:
    """For each shard and cell: the box and number of its points, and the shard's range of mapping within the cell."""
    by = df.groupBy("part", "shard", F.floor("mapping").cast("long").alias("cell"))
    return by.agg(*bounds(vector("x", d)), F.min("mapping").alias("m_lo"), F.max("mapping").alias("m_hi"), F.count(F.lit(1)).alias("n"))


def cell_shards(df: DataFrame) -> DataFrame:
    """cell, part, shard: the shards that have points of a cell."""
    return df.select(F.floor("mapping").cast("long").alias("cell"), "part", "shard").distinct()


@dataclass(frozen=True)
class LearnedIndex:
    """Points with cell, mapping, part, shard and page, and the small tables about them.

    cells: cell, lo0.., hi0.. (bounds of its points), n, flo0.., fhi0.. (its frame, in which the mapping is measured).
    models: part, alpha, beta. parts: part, m_lo, m_hi, n. rects: part, shard, cell, bounds, m_lo, m_hi, n, page_lo,
    page_hi: what of a shard lies in one cell. group, if the points are stored, is the column of their folders.
    """

    points: DataFrame
    cells: DataFrame
    models: DataFrame
    parts: DataFrame
    rects: DataFrame
    key: tuple[str, ...]
    d: int
    psi: int
    n_cells: int
    grid: Grid | None = None
    groups: int = 0

    @classmethod
    def build(cls, points: Points, shape: tuple[int, ...], parts: int | None = None, breaks: int = 10, psi: int = 50, border_eps: float = 0.01, model: tuple | None = None) -> LearnedIndex:
        """Over the cells of an equi-depth grid."""
        grid = Grid.fit(points, shape, border_eps)
        placed = grid.place(points)
        return cls.over(points.with_df(placed), grid.frames(grid.occupied(placed)), grid.n_cells, parts, breaks, psi, model, grid)

    @classmethod
    def build_kd(cls, points: Points, leaf: int, parts: int | None = None, breaks: int = 10, psi: int = 50, border_eps: float = 0.01, model: tuple | None = None, levels: int | None = None) -> LearnedIndex:
        """Over the leaves of a KD-tree, of `levels` levels at most."""
        df, cells = kd_cells(kd_nodes(points, leaf, levels=levels), points.d, border_eps)
        frames = [F.col(f"lo{i}").alias(f"flo{i}") for i in range(points.d)] + [(F.col(f"hi{i}") + F.lit(border_eps)).alias(f"fhi{i}") for i in range(points.d)]
        return cls.over(points.with_df(df), cells.select("*", *frames), cells.count(), parts, breaks, psi, model)

    @classmethod
    def over(cls, placed: Points, cells: DataFrame, n_cells: int, parts: int | None = None, breaks: int = 10, psi: int = 50, model: tuple | None = None, grid: Grid | None = None) -> LearnedIndex:
        """Over points that have cell and mapping. parts: by default as many as have PART_ROWS points each.

        model: (alpha, beta) for all parts, instead of trained ones.
        """
        d, key, spark = placed.d, placed.key, placed.df.sparkSession
        cells = stash(cells, "learned-cells")
        if parts is None:
            parts = max(PARTS, -(-(cells.agg(F.sum("n")).first()[0] or 0) // PART_ROWS))
        ranked = partitioned(placed.df, key, parts)
        if model is None:
            models = stash(train(ranked, breaks), "learned-models")
        else:
            models = spark.createDataFrame([(i, [float(a) for a in model[0]], [float(b) for b in model[1]]) for i in range(parts)], "part int, alpha array<double>, beta array<double>")
        df = stash(sharded(ranked, models, key, psi), "learned-points")
        pages = df.groupBy("part", "shard", "cell").agg(F.min("page").alias("page_lo"), F.max("page").alias("page_hi"))
        rects = stash(shard_bounds(df, d).join(pages, ["part", "shard", "cell"]), "learned-rects")
        return cls(df, cells, models, stash(partition_bounds(df), "learned-parts"), rects, key, d, psi, n_cells, grid)

    @property
    def x(self) -> list[Column]:
        return vector("x", self.d)

    def levels(self, fans: Sequence[int] | None = None) -> list[DataFrame]:
        """Groups of cells, and cells."""
        return hierarchy(self.cells, self.d, "cell", fans)

    def shards(self, part: int) -> DataFrame:
        """shard, m_lo, m_hi, n: the shards of a part."""
        return self.rects.where(F.col("part") == part).groupBy("shard").agg(F.min("m_lo").alias("m_lo"), F.max("m_hi").alias("m_hi"), F.sum("n").alias("n"))

    def shard(self, part: int, shard: int) -> DataFrame:
        """The rows of a shard; none, if there is no such shard."""
        return self.points.where((F.col("part") == part) & (F.col("shard") == shard))

    def shard_boxes(self, part: int, shard: int) -> DataFrame:
        """The boxes of a shard, one for each cell it has points in."""
        return self.rects.where((F.col("part") == part) & (F.col("shard") == shard))

    def ranges(self, boxes: DataFrame, fans: Sequence[int] | None = None) -> DataFrame:
        """bid, a0.., b0.. (the box), cell, m_lo, m_hi, part, s_lo, s_hi: where a box's points can be.

        A box is cut at the frames of the cells whose points it meets. Within a cell the mapping doesn't fall in any
        coordinate, so the piece's corners bound the mapping of its points; the parts that have this range of the
        cell come from the directory, and the shards from the model.
        """
        d = self.d
        a, b, flo, fhi = (vector(x, d) for x in ("a", "b", "flo", "fhi"))
        met = met_nodes(boxes, self.levels(fans), d).withColumnRenamed("node", "cell")
        met = salted_join(met, self.cells.select("cell", *flo, *fhi), ["cell"], ["bid"])

        def mapped(corner: Sequence[Column]) -> Column:
            part = whole = None
            for x, low, high in zip(corner, flo, fhi, strict=True):
                part, whole = (x - low, high - low) if part is None else (part * (x - low), whole * (high - low))
            return F.col("cell") + F.coalesce(F.try_divide(part, whole), F.lit(0.0))

        low, high = mapped([F.greatest(x, y) for x, y in zip(a, flo, strict=True)]), mapped([F.least(x, y) for x, y in zip(b, fhi, strict=True)])
        pieces = met.select("bid", *a, *b, "cell", low.alias("m_lo"), high.alias("m_hi"))
        held = self.rects.groupBy("cell", "part").agg(F.min("m_lo").alias("p_lo"), F.max("m_hi").alias("p_hi"))
        pieces = salted_join(pieces, held, ["cell"], ["bid"]).where("p_lo <= m_hi and p_hi >= m_lo")
        known = pieces.join(bounded_broadcast(self.models.select("part", "alpha", "beta")), "part")
        first, last = shards_between(F.greatest("m_lo", "p_lo"), F.least("m_hi", "p_hi"), F.col("alpha"), F.col("beta"), self.psi)
        return known.select("bid", *a, *b, "cell", "m_lo", "m_hi", "part", first.alias("s_lo"), last.alias("s_hi"))

    def fetch(self, boxes: DataFrame, fans: Sequence[int] | None = None, points: DataFrame | None = None) -> DataFrame:
        """bid, a0.., b0.. and the points of the shards and ranges of mapping that boxes lead to: more than the boxes hold."""
        asked = self.ranges(boxes, fans)
        sizes = self.rects.groupBy("part", "cell").agg(F.sum("n").alias("n"))
        rows = split_join(self.points if points is None else points, asked, ["part", "cell"], sizes, self.key)
        fits = F.col("shard").between(F.col("s_lo"), F.col("s_hi")) & F.col("mapping").between(F.col("m_lo"), F.col("m_hi"))
        return rows.where(fits).drop("m_lo", "m_hi", "s_lo", "s_hi")

    def boxes(self, boxes: DataFrame, fans: Sequence[int] | None = None) -> DataFrame:
        """bid and the points of each box. boxes: bid, lo0.., hi0.. ."""
        found = self.fetch(boxes, fans).where(in_box(self.x, vector("a", self.d), vector("b", self.d)))
        return found.drop(*[f"{name}{i}" for name in "ab" for i in range(self.d)])

    def box_costs(self, boxes: DataFrame, fans: Sequence[int] | None = None) -> DataFrame:
        """bid, n_rows, fetched, pages: points of a box, points fetched for it, and distinct pages that these lie in."""
        inside = in_box(self.x, vector("a", self.d), vector("b", self.d))
        by = self.fetch(boxes, fans).groupBy("bid")
        return by.agg(F.count(F.when(inside, 1)).alias("n_rows"), F.count(F.lit(1)).alias("fetched"), F.count_distinct("part", "shard", "page").alias("pages"))

    def box(self, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
        """The points of one box: through the model, from the folders and cells that the box meets alone."""
        spark = self.points.sparkSession
        row = spark.createDataFrame([(0, *map(float, lo), *map(float, hi))], ", ".join(["bid int", *[f"{x}{i} double" for x in ("lo", "hi") for i in range(self.d)]]))
        found = self.fetch(row, points=self.points.where(self.meets(lo, hi))).where(in_box(self.x, constants(lo), constants(hi)))
        return found.drop("bid", *[f"{name}{i}" for name in "ab" for i in range(self.d)])

    def meets(self, lo: Sequence[float], hi: Sequence[float], listed: int = 1000) -> Column:
        """Condition on cells, and on the folders of stored points, for those that a box meets: by number, if no more than `listed`."""
        met = self.cells.where(boxes_overlap(vector("lo", self.d), vector("hi", self.d), constants(lo), constants(hi)))
        found = [row["cell"] for row in met.select("cell").limit(listed + 1).collect()]
        if not found:
            return F.lit(False)
        if len(found) <= listed:
            condition, folders = F.col("cell").isin(found), sorted({self.group_of(c) for c in found})
            return condition & F.col("cell_group").isin(folders) if self.groups else condition
        first, last = met.agg(F.min("cell"), F.max("cell")).first()
        condition = F.col("cell").between(first, last)
        return condition & F.col("cell_group").between(self.group_of(first), self.group_of(last)) if self.groups else condition

    def group_of(self, cell: int) -> int:
        """The folder of a stored cell."""
        return cell * self.groups // max(1, self.n_cells)

    def near_rects(self, queries: DataFrame, k: int, fans: Sequence[int] | None = None) -> DataFrame:
        """qid, q0.., md, part, shard, cell, n, page_lo, page_hi: what of the shards can hold one of a query's k nearest.

        The descent goes on from the cells to the boxes of shards in them.
        """
        below = self.rects.select(F.struct("part", "shard", "cell").alias("node"), F.col("cell").alias("parent"), *vector("lo", self.d), *vector("hi", self.d), "n")
        found = near_nodes(queries, [*self.levels(fans), below], k, self.d).select("qid", *vector("q", self.d), "md", "node.*")
        return salted_join(found, self.rects.select("part", "shard", "cell", "n", "page_lo", "page_hi"), ["part", "shard", "cell"], ["qid"])

    def nearest(self, queries: DataFrame, k: int, fans: Sequence[int] | None = None) -> DataFrame:
        """Each query's k nearest with d2 and rn, from the shards' boxes within reach alone. queries: qid, q0.. ."""
        return nearest_in_groups(Points(self.points, self.key, self.d), self.near_rects(queries, k, fans), k, ["part", "shard", "cell"], self.rects.select("part", "shard", "cell", "n"))

    def nearest_costs(self, queries: DataFrame, k: int, fans: Sequence[int] | None = None) -> DataFrame:
        """qid, rects, tested, pages: boxes of shards within reach, their points, and the distinct pages that these lie in."""
        near = self.near_rects(queries, k, fans)
        each = near.select("qid", "part", "shard", F.explode(F.sequence("page_lo", "page_hi")).alias("page"))
        pages = each.groupBy("qid").agg(F.count_distinct("part", "shard", "page").alias("pages"))
        return near.groupBy("qid").agg(F.count(F.lit(1)).alias("rects"), F.sum("n").alias("tested")).join(pages, "qid")
