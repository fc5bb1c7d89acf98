import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm.additive_search import Codebooks, build_index, fit_codebooks, nearest, op4_additive_search
from lattica.llm.exact_search import OP1_SQL, exact_top_k, op1_exact_top_k
from lattica.llm.tiles import best_of, finite


def test_best_of_ties():
    keys, ids = np.array([3, 1, 1, 2, 1]), np.array([5, 9, 4, 1, 7])
    assert ids[best_of(keys, ids, 2)].tolist() == [4, 7]
    assert ids[best_of(keys, ids, 9)].tolist() == [4, 7, 9, 1, 5]


def top(rows, queries, k):
    out = []
    for q, v in queries:
        found = sorted({(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i is not None and i != q and w is not None and len(w) == len(v)})
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_exact_top_k_of_odd_rows(spark):
    draw = np.random.default_rng(2)
    rows = [(int(i), draw.integers(-3, 4, 4).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (100, None), (101, []), (None, [1, 1, 1, 1]), (102, [1, 2]), (103, [2, 1]), (104, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, v array<long>, score string")
    queries = [(i, v) for i, v in rows if i in (0, 7, 102, 104)]
    queries = [q for n, q in enumerate(queries) if q not in queries[:n]]
    asked = df.where("vec_id in (0, 7, 102, 104)")
    assert sorted(map(tuple, exact_top_k(asked, df, 5).collect())) == top(rows, queries, 5)
    assert exact_top_k(asked, df.where("vec_id < 0"), 5).count() == 0
    assert exact_top_k(asked.where("vec_id < 0"), df, 5).count() == 0


def test_many_tiles(spark, monkeypatch):
    from lattica.llm import tiles

    for name, value in (("BLOCK", 3), ("SHARD", 4), ("FAN_IN", 2)):
        monkeypatch.setattr(tiles, name, value)
    draw = np.random.default_rng(4)
    rows = [(int(i), draw.integers(-2, 3, 3).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    assert sorted(map(tuple, exact_top_k(df.where("vec_id % 5 = 0"), df, 4).collect())) == top(rows, [r for r in rows if r[0] % 5 == 0], 4)


def test_candidates_are_not_gathered(spark, monkeypatch):
    """Candidates aren't shuffled, and no row holds many of them: both took an executor's heap over millions of vectors."""
    from lattica.llm import tiles

    plans, write = [], tiles.stash
    monkeypatch.setattr(tiles, "stash", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name))[1])
    monkeypatch.setattr(tiles, "SHARD", 100)
    df = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7, F.col("id") % 11).alias("v")).repartition(3)
    found = exact_top_k(df.where("vec_id % 50 = 0"), df, 5)
    assert found.count() == 200
    assert [name for name, _ in plans] == ["queries", "wave"]
    assert all("collect_set" not in plan for _, plan in plans)
    scan, _, _ = plans[1][1].partition("MapInArrow")[2].partition("Coalesce")
    assert "Exchange" not in scan


def test_streams_of_many_chunks(spark, monkeypatch):
    """Rows alike count once within a chunk, in different ones and in different streams; ties go to the smaller id."""
    from lattica.llm import tiles

    for name, value in (("BLOCK", 8), ("SHARD", 100), ("STRIP", 3), ("CHUNK", 7)):
        monkeypatch.setattr(tiles, name, value)
    draw = np.random.default_rng(14)
    rows = [(int(i), draw.integers(-2, 3, 3).tolist()) for i in range(150)] * 3
    rows += [(3, [2, 2, 2]), (3, [2, 2, 2]), (200, [1, 1])] + [(201 + i, [2, 1, 2]) for i in range(60)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(4)
    asked = sorted({(i, tuple(v)) for i, v in rows if i % 10 == 0})
    assert sorted(map(tuple, exact_top_k(df.where("vec_id % 10 = 0"), df, 4).collect())) == top([(i, tuple(v)) for i, v in rows], asked, 4)


@pytest.mark.parametrize("big", [1 << 27, 1 << 30, 1 << 62])
def test_large_products(spark, big):
    rows = [(0, [big, big]), (1, [big, -big]), (2, [big - 1, big]), (3, [1, 0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    most = (1 << 63) - 1
    expected = sorted((-max(-most, min(most, big * w[0] + big * w[1])), i) for i, w in rows[1:])
    found = [(-r["score"], r["vec_id"]) for r in exact_top_k(df.where("vec_id = 0"), df, 3).orderBy("rank").collect()]
    assert found == expected


def test_finite(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, None), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in df.where(finite(F.col("embedding"))).collect()] == [1]


def test_exact_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    columns = ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, op1_exact_top_k(spark, sf_dir).select(*columns).collect())) == sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({OP1_SQL})").fetchall())


def distances(v, q):
    d = np.sqrt(((v - v[q]) ** 2).sum(1))
    d[q] = np.inf
    return d


def test_approximate_recall(spark):
    draw = np.random.default_rng(8)
    v = (draw.normal(size=(6, 16))[draw.integers(0, 6, 4000)] + draw.normal(size=(4000, 16)) * 0.5).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    model = fit_codebooks(df)
    index = build_index(df, model).cache()
    found = nearest(df.where("vec_id % 100 = 0"), index, model, 10, rerank=100).toPandas()
    hits = 0
    for q, rows in found.groupby("query_id"):
        rows, d = rows.sort_values("rank"), distances(v, q)
        assert len(rows) == 10 and (np.diff(rows.score) >= 0).all()
        np.testing.assert_array_equal(rows.score, d[rows.vec_id])
        hits += len(set(rows.vec_id) & set(np.argsort(d, kind="stable")[:10]))
    assert hits / (10 * 40) >= 0.95


@pytest.mark.parametrize("k", [10, 300])
def test_many_copies(spark, k):
    """A third of 20,000 rows alike: ties go to the smaller id, for queries in the group and beside it."""
    draw = np.random.default_rng(11)
    v = (draw.normal(size=(6, 16))[draw.integers(0, 6, 20_000)] + draw.normal(size=(20_000, 16)) * 0.5).astype(np.float32).astype(float)
    copies = draw.random(20_000) < 1 / 3
    v[copies] = v[0]
    v[50] = v[0] + 1e-3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    model = fit_codebooks(df)
    index = build_index(df, model, k).cache()
    hits = asked = 0
    for q, rows in nearest(df.where("vec_id % 500 = 0 or vec_id = 50"), index, model, k).toPandas().groupby("query_id"):
        d = distances(v, q)
        found, best = rows.sort_values("rank").vec_id.tolist(), np.argsort(d, kind="stable")[:k].tolist()
        assert len(found) == k
        np.testing.assert_array_equal(rows.sort_values("rank").score, d[found])
        if copies[q]:
            assert found == best
        if q == 50:
            assert d[found].tolist() == d[best].tolist() and [i for i in found if copies[i]] == [i for i in best if copies[i]]
        hits, asked = hits + len(set(found) & set(best)), asked + k
    assert asked == 41 * k and hits >= 0.95 * asked


def test_many_rows_of_the_query(spark):
    """Rows that share the query's id don't take the places of others."""
    draw = np.random.default_rng(12)
    v = draw.normal(size=(2000, 4))
    ids = [0] * 400 + list(range(1, 1601))
    v[:400] /= 1000
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, v array<double>")
    model = fit_codebooks(df)
    asked = df.where("vec_id = 0").limit(1)
    found = nearest(asked, build_index(df, model), model, 10, rerank=100).orderBy("rank").collect()
    d = np.sqrt(((v[400:] - np.array(asked.collect()[0]["v"])) ** 2).sum(1))
    assert [r["vec_id"] for r in found] == (np.argsort(d, kind="stable")[:10] + 1).tolist()


def test_codebooks_are_fitted_in_a_task(spark, monkeypatch):
    """On the rows of the smallest hashes, of the commonest length; the driver gets the codebooks alone."""
    draw = np.random.default_rng(13)
    df = spark.createDataFrame([(i, draw.normal(size=3 if i % 3 else 2).tolist()) for i in range(3000)], "vec_id long, v array<double>")
    rows = [r["v"] for r in df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(400).collect()]
    expected = Codebooks.fit(np.array([v for v in rows if len(v) == 3])).books

    def refused(*_, **__):
        raise AssertionError("the driver fits")

    with monkeypatch.context() as patch:
        patch.setattr(Codebooks, "fit", refused)
        found = fit_codebooks(df, 400)
    np.testing.assert_allclose(found.books, expected, rtol=1e-5, atol=1e-6)
    alike = spark.range(500).select(F.lit(4).alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    assert fit_codebooks(alike, 20).dim == 1


def test_many_blocks_and_lengths(spark, monkeypatch):
    """Queries of several blocks are ranked again with their own block; doubles that aren't floats, and two lengths."""
    from lattica.llm import tiles

    for name, value in (("BLOCK", 8), ("SHARD", 100)):
        monkeypatch.setattr(tiles, name, value)
    draw = np.random.default_rng(15)
    v = [np.round(draw.normal(size=4 if i % 4 else 5), 0 if i % 2 else 16) for i in range(600)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>")
    model = fit_codebooks(df)
    index = build_index(df, model).cache()
    found = nearest(df.where("vec_id % 10 = 0 or vec_id % 10 = 3"), index, model, 5, rerank=600).toPandas()
    assert found.query_id.nunique() == 120 and len(found) == 600
    for q, rows in found.groupby("query_id"):
        own = sorted((np.sqrt(((x - v[q]) ** 2).sum()), i) for i, x in enumerate(v) if i != q and len(x) == len(v[q]))[:5]
        assert rows.sort_values("rank").vec_id.tolist() == [i for _, i in own]
        np.testing.assert_array_equal(rows.sort_values("rank").score, [d for d, _ in own])


def test_ties_in_all_places(spark):
    """Vectors at one distance from the query: the smaller ids, also where copies and others are level at the cut."""
    rows = [(i, [float(i % 2 * 2 - 1), 0.0]) for i in range(1, 40)] + [(0, [0.0, 0.0]), (50, [0.0, 1.0]), (51, [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    model = fit_codebooks(df)
    index = build_index(df, model).cache()
    found = [(r["vec_id"], r["score"]) for r in nearest(df.where("vec_id = 0"), index, model, 5).orderBy("rank").collect()]
    assert found == [(51, 0.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]


def test_recall_at_fifty_thousand(spark):
    """At a size where what is ranked again is half a percent of all rows."""
    e = spark.read.parquet("/root/testdata/check_l/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(finite(F.col("embedding"))).cache()
    assert e.count() > 50_000
    model = fit_codebooks(e)
    index = build_index(e, model).cache()
    found = nearest(e.where("vec_id % 300 = 0"), index, model, 10).toPandas()
    rows = e.toPandas()
    v, ids, hits = np.stack(rows.v.values), rows.vec_id.to_numpy(), 0
    for q, own in found.groupby("query_id"):
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len(set(own.vec_id) & set(ids[np.lexsort((ids, d))[:10]]))
    assert hits >= 0.95 * len(found)


def test_codes_add_up():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 8))
    model = Codebooks.fit(x, books=4, words=32)
    codes, norms = model.encode(x)
    sums = sum(model.books[m][codes[:, m]] for m in range(4))
    np.testing.assert_allclose(norms, (sums**2).sum(1), rtol=1e-3, atol=1e-3)
    rough = model.approximate(x[:5], codes, norms) + (x[:5] ** 2).sum(1)[:, None]
    np.testing.assert_allclose(rough, ((x[:5, None] - sums[None]) ** 2).sum(2), rtol=1e-2, atol=1e-2)
    wide, _ = model.encode(x, beam=8)
    narrow, _ = model.encode(x, beam=1)
    error = lambda c: ((x - sum(model.books[m][c[:, m]] for m in range(4))) ** 2).sum()
    assert error(wide) <= error(narrow)


def test_approximate_odd_rows(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(40, [1.0, 2.0, 3.0]), (41, [1.0, 2.0, 4.0]), (42, None), (None, [1.0, 1.0]), (5, [5.0, 1.0]), (43, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, v array<double>, code int")
    good = df.where("v is not null and size(v) > 0 and vec_id is not null")
    model = fit_codebooks(good)
    index = build_index(good, model)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in nearest(df.where("vec_id in (0, 40)"), index, model, 3).collect()}
    assert found == {(0, 1): (1, 1.0), (0, 2): (2, 2.0), (0, 3): (3, 3.0), (40, 1): (41, 1.0)}
    none = good.where("vec_id < 0")
    assert nearest(none, build_index(none, fit_codebooks(none)), fit_codebooks(none), 3).count() == 0


def test_approximate_query(spark, sf_dir):
    found = op4_additive_search(spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    v, hits = np.stack(e.embedding.values).astype(float), 0
    for q in np.flatnonzero(e.vec_id % 100 == 0):
        own = found[found.query_id == e.vec_id[q]].sort_values("rank")
        hits += len(set(own.vec_id) & set(e.vec_id[np.argsort(distances(v, q), kind="stable")[:10]]))
    assert hits >= 0.9 * len(found)
