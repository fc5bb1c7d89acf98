import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import lm_scoring
from lattica.llm.common import held_out
from lattica.llm.lm_scoring import WEIGHTS, BackoffAutomaton, Tokens, batch_keys, by_shard, hashed, op7_lm_scoring, pack, score_documents, steps, unpack

END = object()


def brute(rows, weights):
    """rows: doc_id, text, held_out."""
    tokens = [[*(t or "").encode().lower().split(), END] for _, t, _ in rows]
    train = [t for t, (_, _, out) in zip(tokens, rows, strict=True) if not out]
    order = len(weights) + 1
    grams = Counter(tuple([None, *t][i : i + n]) for t in train for n in range(1, order + 1) for i in range(len(t) + 2 - n))
    total, types = sum(map(len, train)), len({w for t in train for w in t})
    result = []
    for (doc, _, out), own in zip(rows, tokens, strict=True):
        base = score = 0.0
        full = [None, *own]
        for i in range(1, len(full)):
            p = (grams[full[i],] + 1) / (total + types + 1)
            base += math.log10(p)
            for n, weight in enumerate(weights, 2):
                if i - n + 1 >= 0:
                    history = tuple(full[i - n + 1 : i])
                    p = (grams[(*history, full[i])] + weight * p) / (grams[history] + weight)
            score += math.log10(p)
        result.append((doc, bool(out), len(own), sum(grams[w,] > 0 for w in own), total, base, score))
    return result


def compare(found, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 6))
    assert len(found) == len(expected)
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-6)


ROWS = [(1, "The cat sat on the mat", False), (2, "the cat SAT", True), (3, None, False), (4, "", True), (None, "no id the", False), (5, "word " * 20_000, False), (1, "again one", False), (6, "É unseen\tthings\nhere", True), (7, "the cat sat on the mat", False)]


def write(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, held_out boolean, score double").repartition(3).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


@pytest.mark.parametrize(("rows", "shards", "weights"), [(2, None, (5.0,)), (3072, 9, (5.0,)), (3, 11, (5.0, 2.0)), (3072, 2, (5.0, 2.0, 1.0))])
def test_odd_rows(spark, tmp_path, monkeypatch, rows, shards, weights):
    monkeypatch.setattr(lm_scoring, "ROWS", rows)
    docs = write(spark, tmp_path, ROWS)
    compare(list(map(tuple, score_documents(docs, weights, shards).select(NAMES).collect())), brute(ROWS, weights))


def test_any_plan(spark, tmp_path):
    """Sorted, limited, united and joined tables; rows of one batch in many tasks."""
    rows = [(i, f"the {i % 7} cat {i % 5} sat " * (i % 90), i % 3 == 0) for i in range(700)]
    docs = write(spark, tmp_path, rows)
    few = spark.range(300).withColumnRenamed("id", "doc_id")
    tables = {
        "sorted": (docs.orderBy("text"), rows),
        "sorted within": (docs.sortWithinPartitions("doc_id"), rows),
        "limited": (docs.orderBy("doc_id").limit(100), rows[:100]),
        "united": (docs.unionByName(docs), rows * 2),
        "joined": (docs.join(few, "doc_id"), rows[:300]),
        "filtered": (docs.where("doc_id % 2 = 0").select("text", "held_out", "doc_id"), rows[::2]),
        "dealt": (docs.repartition(7), rows),
    }
    for name, (df, expected) in tables.items():
        assert lm_scoring.from_files(df) == (name == "filtered")
        compare(list(map(tuple, score_documents(df, (5.0,)).select(NAMES).collect())), brute(expected, (5.0,)))


def test_batches_read_by_many_tasks(spark, tmp_path):
    rows = [(i, f"word{i % 50} and {i} more of it " * 20, i % 4 == 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").coalesce(1)
    docs.write.option("parquet.block.size", 64 << 10).parquet(f"{tmp_path}/docs")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        df = spark.read.parquet(f"{tmp_path}/docs")
        assert df.rdd.getNumPartitions() > 1
        found = score_documents(df, (5.0, 3.0)).select(NAMES).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    compare(list(map(tuple, found)), brute(rows, (5.0, 3.0)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packing(values):
    keys = np.unique(np.array(values, np.uint64))
    assert np.cumsum(unpack(pack(steps(keys)), len(keys)), dtype=np.uint64).tolist() == keys.tolist()
    ends = by_shard(keys, 7)
    assert ends[0] == 0 and [int(k) * 7 >> 64 for k in keys] == np.repeat(np.arange(7), np.diff(ends)).tolist()


def test_nothing_to_learn_from(spark, tmp_path):
    rows = [(i, t, True) for i, t, _ in ROWS[:4]]
    compare([tuple(r) for r in score_documents(write(spark, tmp_path, rows), (5.0,)).select(NAMES).collect()], brute(rows, (5.0,)))


def test_empty_table(spark, tmp_path):
    assert score_documents(write(spark, tmp_path, ROWS).where("doc_id < 0")).count() == 0


def test_tables_not_from_files(spark):
    docs = spark.createDataFrame([*ROWS, (9, "no mark", None)], "doc_id long, text string, held_out boolean")
    compare(list(map(tuple, score_documents(docs, (5.0,)).select(NAMES).collect())), brute([*ROWS, (9, "no mark", False)], (5.0,)))


@pytest.mark.parametrize("weights", [(2.0,), (2.0, 0.5)])
def test_states_are_distributions(weights):
    """After any history the chances of all words and one unknown sum to 1."""
    tokens = Tokens.of([hashed(t) for t in ("a b a c", "b a", "c c c a")])
    words, grams = batch_keys(tokens, np.ones(3), len(weights) + 1)
    total, types = int(tokens.sizes.sum()), len(np.unique(tokens.now))
    model = BackoffAutomaton(words.keys, words.counts, grams.keys, grams.counts, total, types, weights)
    chance = lambda text: model.traverse(Tokens.of([hashed(text)]))[0][0]
    for history in ("a", "b", "c a", "a b", "b c c"):
        # P(history w end) / P(history end) * P(end | history) / P(end | .. w) = P(w | history)
        ends = {h: chance_of_end(model, h) for h in (history, *(f"{history} {w}" for w in "abc"))}
        mass = sum(10 ** (chance(f"{history} {w}") - ends[f"{history} {w}"] - (chance(history) - ends[history])) for w in "abc") + 10 ** ends[history]
        unknown = 1 / (total + types + 1)
        parts = history.split()
        for n, weight in enumerate(weights, 2):
            seen = model.counts[model.word(hashed(parts[-1]))[0]] if n == 2 else model.arc_count(Tokens.of([hashed(history)]).ngrams(2)[0][1])[len(parts) - 1]
            unknown *= weight / (seen + weight)
        assert mass + unknown == pytest.approx(1.0)


def chance_of_end(model, text):
    """log10 of the end's chance after a text."""
    tokens = Tokens.of([hashed(text)])
    word = model.word(tokens.now)
    p, seen = 10 ** model.root[word[-1]], model.counts[word[-2]]
    for weight, (_, keys) in zip(model.weights, tokens.ngrams(model.order), strict=True):
        p = (model.arc_count(keys)[-1] + weight * p) / (seen + weight)
        seen = model.arc_count(keys)[-2] if len(keys) > 1 else 0.0
    return math.log10(p)


def test_query(spark, sf_dir):
    found = [tuple(r) for r in op7_lm_scoring(spark, sf_dir).select(NAMES).collect()]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs]
    compare(found, brute(rows, WEIGHTS))
    unseen = [r for r in found if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


def test_held_out(spark):
    rows = spark.range(50).select("id", held_out(F.col("id"), 7).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 7 == 2) for r in rows)
