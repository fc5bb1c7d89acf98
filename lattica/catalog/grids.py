"""Queries over grids, mappings, partitions, models, shards and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog.base import L, P, boxes_of, grid_sql, lines, number, parts, query
from lattica.functions import geometry as G
from lattica.operators import layout
from lattica.operators.grid import Grid
from lattica.operators.rank_model import predicted, shard_of, squared_error, train
from lattica.plans import search

SHAPE2, SHAPE3 = (10, 10), (8, 10, 5)
LK = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
P_GRID = f"{P}, {grid_sql('p', 'p_partkey', SHAPE2)}"
L_GRID = f"{L}, {grid_sql('l', LK, SHAPE3)}"
#: A model that is given, not trained: constant and slopes, breaks, and rows of a shard.
ALPHA, BETA, PSI = (1.0, 5.0, 1.5, -0.5), (0.0, 20.0, 60.0), 50
PARTS = 5


@query(f"WITH {L}, t AS (SELECT x1, ntile(20) OVER (ORDER BY x1, {LK}) AS chunk FROM l) SELECT DISTINCT min(x1) AS border FROM t GROUP BY chunk")
def borders_ntile(spark, sf_dir):
    from lattica.operators.ranking import values_at

    found, _ = values_at(lines(spark, sf_dir).df, "x1", 20)
    return spark.createDataFrame([(v,) for v in found], "border double")


@query(f"WITH {P_GRID} SELECT p_partkey, s0.lo AS lo0, s0.hi AS hi0, s1.lo AS lo1, s1.hi AS hi1 FROM g JOIN s0 ON g.i0 = s0.j JOIN s1 ON g.i1 = s1.j")
def find_interval(spark, sf_dir):
    p = parts(spark, sf_dir)
    grid = Grid.fit(p, SHAPE2)
    at = [F.col("i0"), F.col("i1")]
    return grid.place(p).select("p_partkey", *[f(i, at[i]).alias(f"{name}{i}") for i in (0, 1) for name, f in (("lo", grid.low), ("hi", grid.high))])


@query(f"WITH {P_GRID} SELECT p_partkey, cell FROM g")
def cell_id_2d(spark, sf_dir):
    p = parts(spark, sf_dir)
    return Grid.fit(p, SHAPE2).place(p).select("p_partkey", "cell")


@query(f"WITH {L_GRID} SELECT {LK}, cell FROM g")
def cell_id_3d(spark, sf_dir):
    p = lines(spark, sf_dir, 3)
    return Grid.fit(p, SHAPE3).place(p).select(*p.key, "cell")


@query(f"WITH {L_GRID} SELECT cell, count(*) AS n, min(x0) AS lo0, min(x1) AS lo1, min(x2) AS lo2, max(x0) AS hi0, max(x1) AS hi1, max(x2) AS hi2 FROM g GROUP BY 1")
def cell_histogram(spark, sf_dir):
    p = lines(spark, sf_dir, 3)
    grid = Grid.fit(p, SHAPE3)
    return grid.occupied(grid.place(p))


@query(f"WITH {P_GRID} SELECT p_partkey, mapping FROM g")
def mapping_2d(spark, sf_dir):
    p = parts(spark, sf_dir)
    return Grid.fit(p, SHAPE2).place(p).select("p_partkey", "mapping")


@query(f"WITH {L_GRID} SELECT {LK}, round(mapping, 9) AS mapping FROM g")
def mapping_3d(spark, sf_dir):
    p = lines(spark, sf_dir, 3)
    return Grid.fit(p, SHAPE3).place(p).select(*p.key, F.round("mapping", 9).alias("mapping"))


@query(f"WITH {P_GRID} SELECT p_partkey, 3e0 + ((x0 - s0.lo) * (x1 - s1.lo)) / ((s0.hi - s0.lo) * (s1.hi - s1.lo)) AS mapping FROM g JOIN s0 ON s0.j = 2 JOIN s1 ON s1.j = 3")
def mapping_forced_cell(spark, sf_dir):
    p = parts(spark, sf_dir)
    grid = Grid.fit(p, SHAPE2)
    lower = G.constants((grid.starts[0][min(2, len(grid.starts[0]) - 1)], grid.starts[1][min(3, len(grid.starts[1]) - 1)]))
    return p.df.select("p_partkey", grid.mapping_in_cell(F.lit(3), lower, p.x).alias("mapping"))


@query(
    f"WITH {P_GRID}, e0 AS (SELECT lo AS a0, hi AS z0 FROM s0 UNION ALL SELECT max(hi), 'inf'::DOUBLE FROM s0), e1 AS (SELECT lo AS a1, hi AS z1 FROM s1 UNION ALL SELECT max(hi), 'inf'::DOUBLE FROM s1)"
    " SELECT greatest(a0, 12.5e0) AS lo0, greatest(a1, 925.5e0) AS lo1, least(z0, 33.5e0) AS hi0, least(z1, 961.5e0) AS hi1 FROM e0, e1 WHERE a0 < 33.5e0 AND z0 > 12.5e0 AND a1 < 961.5e0 AND z1 > 925.5e0"
)
def decompose_box(spark, sf_dir):
    grid = Grid.fit(parts(spark, sf_dir), SHAPE2)
    rows = [(*lo, *hi) for lo, hi in grid.decompose((12.5, 925.5), (33.5, 961.5))]
    return spark.createDataFrame(rows, "lo0 double, lo1 double, hi0 double, hi1 double")


@query(f"WITH {P_GRID} SELECT s0.j * (SELECT count(*) FROM s1) + s1.j AS cell, s0.lo AS lo0, s1.lo AS lo1, s0.hi AS hi0, s1.hi AS hi1 FROM s0, s1")
def grid_cells(spark, sf_dir):
    return Grid.fit(parts(spark, sf_dir), SHAPE2).cells(spark).select("cell", "lo0", "lo1", "hi0", "hi1")


RANKED = f"{P_GRID}, t AS (SELECT *, CAST(ntile({PARTS}) OVER (ORDER BY mapping, p_partkey) - 1 AS INTEGER) AS part FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY mapping, p_partkey) - 1 AS rank FROM t)"


def _ranked(spark, sf_dir):
    p = parts(spark, sf_dir)
    return layout.partitioned(Grid.fit(p, SHAPE2).place(p), p.key, PARTS)


@query(f"WITH {RANKED} SELECT p_partkey, part FROM r")
def partition_ntile(spark, sf_dir):
    return _ranked(spark, sf_dir).select("p_partkey", "part")


@query(f"WITH {RANKED} SELECT part, min(mapping) AS m_lo, max(mapping) AS m_hi, count(*) AS n FROM r GROUP BY 1")
def partition_bounds(spark, sf_dir):
    return layout.partition_bounds(_ranked(spark, sf_dir))


@query(f"WITH {RANKED} SELECT p_partkey, part, rank FROM r")
def rank_in_partition(spark, sf_dir):
    return _ranked(spark, sf_dir).select("p_partkey", "part", "rank")


PREDICTED = f"({number(ALPHA[0])} + " + " + ".join(f"CASE WHEN mapping >= {number(b)} THEN {number(a)} * (mapping - {number(b)}) ELSE 0e0 END" for a, b in zip(ALPHA[1:], BETA, strict=True)) + ")"
SHARDED = f"{RANKED}, h AS (SELECT *, {PREDICTED} AS f, CAST(floor({PREDICTED} / {number(PSI)}) AS BIGINT) AS shard FROM r), w AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY part, shard ORDER BY mapping, p_partkey) - 1) / {number(PSI)}) AS BIGINT) AS page FROM h)"


def _sharded(spark, sf_dir):
    a, b = F.array(*G.constants(ALPHA)), F.array(*G.constants(BETA))
    df = _ranked(spark, sf_dir).withColumn("f", predicted(F.col("mapping"), a, b)).withColumn("shard", shard_of(F.col("mapping"), a, b, PSI).cast("long"))
    return layout.paged(df, ("p_partkey",), PSI)


@query(f"WITH {SHARDED} SELECT p_partkey, part, shard FROM w")
def shard_assign_literal_model(spark, sf_dir):
    return _sharded(spark, sf_dir).select("p_partkey", "part", "shard")


@query(f"WITH {SHARDED} SELECT p_partkey, part, shard, page FROM w")
def page_slice(spark, sf_dir):
    return _sharded(spark, sf_dir).select("p_partkey", "part", "shard", "page")


@query(f"WITH {SHARDED} SELECT part, shard, CAST(floor(mapping) AS BIGINT) AS cell, min(x0) AS lo0, min(x1) AS lo1, max(x0) AS hi0, max(x1) AS hi1, min(mapping) AS m_lo, max(mapping) AS m_hi, count(*) AS n FROM w GROUP BY 1, 2, 3")
def shard_mbr(spark, sf_dir):
    return layout.shard_bounds(_sharded(spark, sf_dir), 2)


@query(f"WITH {SHARDED} SELECT DISTINCT CAST(floor(mapping) AS BIGINT) AS cell, part, shard FROM w")
def cell_shards(spark, sf_dir):
    return layout.cell_shards(_sharded(spark, sf_dir))


@query(f"WITH {SHARDED} SELECT count(*) AS n_rows, count(DISTINCT (part, shard, page)) AS pages FROM w WHERE x0 BETWEEN 10e0 AND 30e0 AND x1 BETWEEN 920e0 AND 960e0")
def page_count_distinct(spark, sf_dir):
    return search.pages_touched(search.in_rectangle(_sharded(spark, sf_dir), (10.0, 920.0), (30.0, 960.0)))


@query(f"WITH {SHARDED} SELECT part, round(sum((f - rank) * (f - rank)), 3) AS loss FROM w GROUP BY 1")
def model_loss(spark, sf_dir):
    df = _sharded(spark, sf_dir)
    return df.groupBy("part").agg(F.round(squared_error(F.col("f"), F.col("rank")), 3).alias("loss"))


@query()
def train_model(spark, sf_dir):
    """part, n, monotone, loss against first_loss: models of the lines' ranks."""
    p = lines(spark, sf_dir, 2)
    ranked = layout.partitioned(Grid.fit(p, (20, 20)).place(p), p.key, 10)
    return train(ranked, breaks=10)


@query()
def learned_index(spark, sf_dir):
    """Rows, shards and pages of a whole learned layout, by part."""
    index = layout.LearnedIndex.build(parts(spark, sf_dir), SHAPE2, parts=PARTS, breaks=5)
    return index.points.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("shards"), F.count_distinct("shard", "page").alias("pages"))


@query(f"WITH {P_GRID} SELECT p_partkey, x0, x1 FROM g WHERE x0 BETWEEN 12.5e0 AND 33.5e0 AND x1 BETWEEN 925.5e0 AND 961.5e0")
def box_indexed(spark, sf_dir):
    p = parts(spark, sf_dir)
    grid = Grid.fit(p, SHAPE2)
    lo, hi = (12.5, 925.5), (33.5, 961.5)
    return search.in_rectangle(grid.place(p).where(grid.meets(lo, hi)), lo, hi).select("p_partkey", "x0", "x1")


@query(f"WITH {P}, d AS (SELECT CAST(n_nationkey AS DOUBLE) AS k FROM nation), b AS (SELECT k AS lo0, 900e0 + k * 3 AS lo1, k + 10 AS hi0, 920e0 + k * 3 AS hi1, CAST(k AS BIGINT) AS bid FROM d) SELECT bid, count(*) AS n FROM p JOIN b ON x0 BETWEEN lo0 AND hi0 AND x1 BETWEEN lo1 AND hi1 GROUP BY 1")
def box_batch_counts(spark, sf_dir):
    return search.batch_boxes(parts(spark, sf_dir), boxes_of(spark, sf_dir)).groupBy("bid").agg(F.count(F.lit(1)).alias("n"))
