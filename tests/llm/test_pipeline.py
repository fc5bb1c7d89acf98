"""The pipeline by its stages, each on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as C
from lattica.llm.byte_bpe import load_ranks
from lattica.llm.common import stash
from lattica.llm.words import shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in C.STAGES:
        found = stash(f(spark, docs, sf_dir), "stage")
        out.append((docs, found))
        docs = found
    return out


def test_quality(stages, spark, sf_dir):
    before, after = stages[0]
    assert after.columns == COLUMNS and 0 < after.count() < before.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    clean = before.join(labels, "doc_id", "left_semi").count()
    assert after.join(labels, "doc_id", "left_semi").count() >= 0.97 * clean


def similar(a, b):
    shared = len(set(a.tolist()) & set(b.tolist()))
    return shared and 100 * shared >= C.SIMILAR * (len(a) + len(b) - shared)


def test_near_duplicates(stages):
    before, after = stages[1]
    assert after.columns == COLUMNS
    sets = {r["doc_id"]: shingle_set(r["text"], C.SHINGLE) for r in before.collect()}
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({find(d) for d in ids})


def test_mixture(stages):
    before, after = stages[2]
    assert after.columns == COLUMNS
    rows = {r["doc_id"]: r for r in before.collect()}
    times = {}
    for r in after.collect():
        assert tuple(r) == tuple(rows[r["doc_id"]])
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    words = lambda ids: sum(len(rows[d]["text"].split()) * n for d, n in ids)
    assert words(times.items()) == pytest.approx(words((d, 1) for d in rows), rel=0.02)


def test_token_ids(stages):
    before, after = stages[3]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = sorted((r["doc_id"], encoding.encode_ordinary(r["text"])) for r in before.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in after.collect()) == expected
    assert all(r["n_tokens"] == len(r["ids"]) for r in after.collect())


def test_decoded(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"), allowMissingColumns=True)
    docs = stash(docs, "docs")
    expected = sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in C.token_ids(spark, docs, sf_dir).collect()) == expected


def test_run(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())
    assert key(C.run(spark, sf_dir)) == key(stages[3][1])


@pytest.fixture(scope="module")
def odd(spark):
    good = "The house was there, with a door, and a man who had seen it. "
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, good, "en", "a", 1), (None, good, "en", "a", 1), (3, good * 3, None, "b", 2), (3, good * 3, None, "b", 2), (3, good + "x", "en", None, 2), (4, good * 3 + "!", "en", "b", 3), (5, "long word " * 50_000, "en", "c", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def expected_rows(docs):
    """Of the groups of linked rows among distinct ones, that with the smallest id."""
    rows = list({tuple(r): r for r in docs.collect() if r["doc_id"] not in (1, 2, 5)}.values())
    sets = [shingle_set(r["text"], C.SHINGLE) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if similar(sets[i], sets[j]):
                    group[j] = group[i] = min(group[i], group[j])
    best = {}
    for r, g in zip(rows, group, strict=True):
        own = (r["doc_id"] is None, r["doc_id"] or 0)
        if g not in best or own < best[g][0]:
            best[g] = own, (r["doc_id"] or -1, r["text"])
    return sorted(x for _, x in best.values())


def test_mixture_keeps_repeated_rows(spark, sf_dir):
    """One source alone is taken whole: eight rows with repeats stay eight."""
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(2, "a b c", "en", "s", 5)] * 2 + [(3, "d", None, "s", 1), (4, "e f", "en", "s", 2), (None, "g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, map(tuple, C.mixture(spark, docs, sf_dir).collect()))) == sorted(map(str, rows))


def test_rows_that_share_an_id(spark, sf_dir):
    """Clean texts stay, though their ids repeat; copies go, though theirs don't."""
    rows = [(5, "one text about the sea and ships that sail on it"), (5, "quite another one of hills and the sheep that graze there"), (2, "one text about the sea and ships that sail on it"), (None, "a third without a name that nobody else has written"), (None, "quite another one of hills and the sheep that graze there")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r)[:2] for r in C.near_duplicates(spark, docs, sf_dir).collect()} == {rows[1], rows[2], rows[3]}


@pytest.mark.parametrize("number", range(4))
def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, odd, number):
    _, f = C.STAGES[number]
    for docs in (odd, odd.where("doc_id < 0")):
        found = f(spark, docs, sf_dir)
        rows = found.collect()
        assert docs is odd or not rows
        if number < 3:
            assert found.columns == COLUMNS
        if docs is odd and number == 1:
            # Alike rows are one; the row without an id is linked with those of id 3, and two of these with each other.
            assert sorted(((r["doc_id"] or -1), r["text"]) for r in rows if r["doc_id"] not in (1, 2, 5)) == expected_rows(docs)
            assert {1, 2, 5} <= {r["doc_id"] for r in rows}
        if docs is odd and number == 2:
            have = Counter(map(str, docs.collect()))
            assert all(n <= 3 * have[r] for r, n in Counter(map(str, rows)).items())
        if docs is odd and number == 3:
            assert len(rows) == docs.count()
