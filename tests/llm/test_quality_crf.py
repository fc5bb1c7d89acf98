import itertools
import zlib

import numpy as np
import pytest

from lattica.llm.quality_crf import Chains, QualityField, features_of, learn, learn_and_score, line_features, op9_quality_crf, score, sigmoid, train


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(0)
    text = np.array([0, 0, 0, 0, 1, 2, 2])
    e, t = draw.normal(size=7), draw.normal(size=(2, 2))
    ahead, back = Chains(text).odds(e, t)
    for number in range(3):
        at = np.flatnonzero(text == number)
        weights = {}
        for y in itertools.product((0, 1), repeat=len(at)):
            weights[y] = np.exp(sum(e[i] * v for i, v in zip(at, y, strict=True)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
        total = sum(weights.values())
        for k, i in enumerate(at):
            assert sigmoid(ahead[i] + back[i]) == pytest.approx(sum(w for y, w in weights.items() if y[k]) / total)


def test_line_features():
    lines = line_features([b"Good words here.\n\n  \nBAD!! BAD!! BAD!!", b"", b"one|two 12", "é".encode()])
    assert lines.text.tolist() == [0, 0, 2, 3] and lines.length.tolist() == [16, 17, 10, 2]
    assert np.isfinite(lines.x).all()
    names = dict(zip(("words", "upper", "doubled"), lines.x[:, [0, 1, 12]].T, strict=True))
    assert names["words"][0] == pytest.approx(np.log1p(3)) and names["upper"][1] > 0.5 and names["doubled"][1] == pytest.approx(2 / 3)
    parts = features_of([b"a b", b"c", b"", b"d\ne"], size=2)
    assert parts.text.tolist() == [0, 1, 3, 3]
    assert len(line_features([b""]).x) == 0


def good(i):
    return "\n".join(f"The house of number {i} and line {j} was there, with a door." for j in range(1 + i % 5))


def bad(i):
    return "\n".join("BUY!! NOW!! $$$ " * (2 + i % 3) for _ in range(1 + i % 4))


def test_learns_to_tell_apart():
    texts = [good(i).encode() for i in range(120)] + [bad(i).encode() for i in range(40)]
    labels = np.array([1] * 120 + [0] * 40)
    field = train(texts, labels, 0.75)
    s = field.scores([good(7).encode() + b" And more.", bad(9).encode(), b"", b" \n"])
    assert s[0] > 0.9 and s[1] < 0.1 and s[2] == s[3] == 0.75
    mixed = field.line_marginals(line_features([(good(4) + "\n" + bad(3)).encode()]))
    assert mixed[0] > mixed[-1]


def test_nothing_to_learn():
    assert train([b"x"], np.array([1]), 1.0).scores([b"y"]).tolist() == [1.0]
    assert QualityField(0.5).scores([]).tolist() == []
    assert train([b"", b" "], np.array([1, 0]), 0.5).scores([b"y"]).tolist() == [0.5]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, good(i) if i % 4 else bad(i), "x", 0.0) for i in range(200)]
    rows += [(500, None, "x", 0.0), (501, "", "x", 0.0), (None, good(3), "x", 0.0), (3, good(8), "x", 0.0), (502, "word " * 200_000, "x", 0.0)]
    marks = [(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, 1, 0), (900, 0, 0), (6, None, 0), (502, 7, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_odd_rows(tables):
    docs, labels = tables
    found = learn_and_score(docs, labels)
    assert found.columns == ["doc_id", "text", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    by_id = {r["doc_id"]: r["predicted"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 200}
    assert np.mean([by_id[i] == int(i % 4 > 0) for i in by_id]) > 0.95


def test_held_out_labels_and_other_columns_are_not_used(spark, tables):
    docs, labels = tables
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r["doc_id"], r["text"]): r["score"] for r in learn_and_score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_empty_tables(tables):
    docs, labels = tables
    assert learn_and_score(docs.where("doc_id < 0"), labels).count() == 0
    rows = learn_and_score(docs, labels.where("doc_id < 0")).collect()
    assert {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {0}


def test_sample_is_bounded(tables):
    docs, labels = tables
    field = learn(docs, labels, sample=20, chars=3000)
    assert field.weights is not None
    assert learn(docs, labels, sample=20, chars=1).weights is None
    assert score(docs, field).count() == docs.count()


def test_long_documents_and_their_label_are_not_left_out(spark):
    """Good ones are long, bad ones short and more than the bound holds: both are learned from."""
    rows = [(i, " ".join([good(i)] * 40) if i % 4 == 0 else bad(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int")
    short = sum(len(t) for i, t in rows if i % 4)
    assert max(len(t) for i, t in rows if i % 4) < min(len(t) for i, t in rows if i % 4 == 0) < short // 4
    assert learn(docs, labels, chars=short // 2).weights is not None


def test_share_of_characters():
    from lattica.llm.quality_crf import within

    row = lambda *sizes: [{"chars": n, "at": (len(sizes), i)} for i, n in enumerate(sizes)]
    sizes = lambda *lists, chars: [r["chars"] for r in within([row(*x) for x in lists], chars)]
    assert sizes([40, 1, 60, 5], [30], chars=100) == [40, 1, 5, 30]
    assert sizes([70, 5], [10], chars=100) == [5, 10, 70]
    assert sizes([9, 9], [1, 1], chars=1) == [1]
    assert sizes([], [80, 30], chars=100) == [30]


def test_query(spark):
    """At a larger size, so that there are enough held-out labels."""
    import os

    sf_dir = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else "/root/testdata/sf0.001"
    found = op9_quality_crf(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = found[found.held_out].merge(labels, on="doc_id")
    assert (rows.predicted == rows.quality).mean() >= 0.93


def test_query_against_all_labellings(spark, tmp_path):
    """The query's scores by summing over every labelling of each text's lines, with the weights that it learns."""
    texts = {i: good(i) if i % 3 else bad(i) for i in range(120)} | {120: "", 121: None, 122: " \n ", 123: good(1) + "\n" + bad(2)}
    docs = spark.createDataFrame([*texts.items(), (7, texts[9])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    field = learn(docs.where(~docs.doc_id.isin([i for i in texts if held(i)])), labels)

    def brute(text):
        lines = line_features([(text or "").encode()])
        n = len(lines.x)
        if not n:
            return field.base
        x = np.vstack([np.zeros(lines.x.shape[1]), (lines.x - field.mean) / field.scale, np.zeros(lines.x.shape[1])])
        own = [np.concatenate([x[i], [1.0], x[i - 1], x[i + 1]]) @ field.weights for i in range(1, n + 1)]
        total, fine = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(own[i] for i in range(n) if y[i]) + sum(field.steps[a, b] for a, b in itertools.pairwise(y)))
            total, fine = total + weight, fine + weight * np.array(y)
        share = min(max(float(lines.length @ (fine / total) / lines.length.sum()), 1e-4), 1 - 1e-4)
        a, b = field.curve
        return float(sigmoid(a * np.log(share / (1 - share)) + b))

    assert field.weights is not None
    found = sorted((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in op9_quality_crf(spark, str(tmp_path)).collect())
    expected = sorted((i, held(i), brute(t)) for i, t in [*texts.items(), (7, texts[9])])
    assert [r[:2] for r in found] == [r[:2] for r in expected]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in expected], abs=1e-9)
    assert all(p == int(s >= 0.7) for _, _, s, p in found)
