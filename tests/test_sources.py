"""Made data, images, the command line and streams."""

import json

from lattica import cli
from lattica.operators.points import Points
from lattica.sources import synthetic
from lattica.sources.store import load_tree
from lattica.streaming.append import append_stream, version_path


def test_made_points_and_boxes(spark):
    a = synthetic.uniform_points(spark, 500, 3, -2.0, 5.0, seed=1)
    rows = a.collect()
    assert len(rows) == 500 and all(-2 <= v < 5 for r in rows for v in r[1:])
    assert rows == synthetic.uniform_points(spark, 500, 3, -2.0, 5.0, seed=1).collect()
    for r in synthetic.query_boxes(spark, [0.0, 10.0], [100.0, 20.0]).collect():
        assert 0 <= r["hi0"] - r["lo0"] <= 25 and 0 <= r["hi1"] - r["lo1"] <= 2.5 and 0 <= r["lo0"] <= 100


def test_image_points(spark):
    image = [(i * 7) % 251 for i in range(3072)]
    df = spark.createDataFrame([(image,), (image,)], "image array<int>")
    found = {tuple(r) for r in synthetic.image_points(df, "image").collect()}
    at = lambda c, p: image[1024 * c + 32 * p[0] + p[1]]
    assert found == {tuple(at(c, p) for p in pair for c in range(3)) for pair in synthetic.PIXEL_PAIRS}


def test_command_line(spark, tmp_path):
    synthetic.uniform_points(spark, 200, 2, 0.0, 10.0).write.parquet(f"{tmp_path}/points")
    spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0)], "qid long, q0 double, q1 double").write.parquet(f"{tmp_path}/queries")
    results = []
    for index in ("grid", "kd", "rtree"):
        out = f"{tmp_path}/out-{index}"
        cli.main(["--index", index, "-i", f"{tmp_path}/points", "-q", f"{tmp_path}/queries", "-o", out, "-d", f"{tmp_path}/index-{index}", "--nearest", "3"])
        results.append(sorted(map(tuple, spark.read.parquet(f"{out}/nearest").select("qid", "rn", "pid").collect())))
        assert spark.read.json(f"{out}/metrics").count() == len(cli.KS)
    assert results[0] == results[1] == results[2] and len(results[0]) == 6


def test_stream_grows_a_tree(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    checkpoint = f"{tmp_path}/checkpoint"
    for number in range(2):
        rows = [{"pid": number * 100 + i, "x0": float(i % 10), "x1": float(i // 10)} for i in range(60)]
        (source / f"{number}.json").write_text("\n".join(map(json.dumps, rows)))
        stream = spark.readStream.schema("pid long, x0 double, x1 double").json(str(source))
        running = append_stream(stream, f"{tmp_path}/tree", ["pid"], ["x0", "x1"], checkpoint, capacity=8)
        running.processAllAvailable()
        running.stop()
        tree = load_tree(spark, version_path(f"{tmp_path}/tree", number))
        assert tree.points.df.count() == 60 * (number + 1)
        assert tree.nodes.where("parent is null").first()["n"] == 60 * (number + 1)


def test_points_from_columns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert Points.of(df, ["p_partkey"], ["p_size", "p_retailprice"]).df.dtypes[1:] == [("x0", "double"), ("x1", "double")]
