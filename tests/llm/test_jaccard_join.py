import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.graph import components
from lattica.llm.jaccard_join import Bands, SignatureTree, in_order, jaccard_components, op2_jaccard_join, similarity_join, tree_join
from lattica.llm.words import lower_words, shingle_set


def shingles(text, n):
    words = lower_words(text or "")
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, n, percent):
    """(doc_id, n_shingles, component_id, n_links) for each row."""
    sets = [(doc, shingles(text, n)) for doc, text in rows]
    up, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, (a, s)), (j, (b, t)) in itertools.combinations(enumerate(sets), 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            links[i] += 1
            links[j] += 1
            up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), None if doc is None else least[find(i)], links[i]) for i, (doc, s) in enumerate(sets)), key=repr)


def rows_of(seed, n_docs):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") + draw.choice("klmnopqrst") + draw.choice("uvwxyz")
    shared = [word() for _ in range(60)]
    rows = []
    for doc in range(n_docs):
        if rows and draw.random() < 0.6:
            words = (draw.choice(rows)[1] or "x").split()
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4, 8])):
                if words:
                    at = draw.randrange(len(words))
                    words[at : at + draw.choice([0, 1])] = [word()] * draw.choice([0, 1, 1])
        else:
            words = [word() for _ in range(draw.choice([1, 2, 3, 5, 10, 40, 150]))]
            if draw.random() < 0.4:
                words = shared + words
        text = draw.choice([" ", "\n", "\t "]).join(words)
        rows.append((doc, text.upper() if draw.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent", "block"), [(1, 3, 90, 10**6), (2, 5, 80, 10**6), (3, 3, 90, 300), (4, 5, 80, 500), (5, 2, 50, 400), (6, 3, 100, 10**6)])
def test_against_all_pairs(spark, seed, n, percent, block):
    rows = rows_of(seed, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df, n, percent, block).collect()), key=repr) == brute(rows, n, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (5, "Two  WORDS"), (6, "É word"), (7, "é word"), (None, "two words"), (8, long), (9, long + " more"), (10, long), (10, "two words"), (11, "a b c")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, component_id string, size int")
    assert sorted(map(tuple, jaccard_components(df, 3, 90).collect()), key=repr) == brute(rows, 3, 90)


def test_texts_that_share_an_id(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo twentythree twentyfour "
    rows = [(5, text + "x"), (5, text + "y"), (7, text + "z"), (5, "quite another text of many other words"), (4, "quite another text of many other words"), (4, "a"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, 3, 90).collect()), key=repr) == brute(rows, 3, 90)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_all_pairs_of_classes(spark):
    rows = rows_of(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, classes, links = similarity_join(df, 3, 80, all_pairs=True)
    rep = {r["h1"]: r["rep"] for r in classes.collect()}
    first = {}
    for doc, text in rows:
        first.setdefault(frozenset(shingles(text, 3)), doc)
    expected = {(min(a, b), max(a, b)) for (s, a), (t, b) in itertools.combinations(first.items(), 2) if s and t and 100 * len(s & t) >= 80 * len(s | t)}
    assert {tuple(sorted((rep[r["a"]], rep[r["b"]]))) for r in links.where("b is not null").collect()} == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**6), st.sampled_from([50, 80, 90, 100]))
def test_bands_hold_linked_sizes(size, percent):
    bands = Bands(percent)
    largest = size * 100 // percent
    assert bands.of(largest) - bands.of(size) in (0, 1)
    overlap = -(-percent * (size + largest) // (100 + percent))
    assert size + largest - 2 * overlap <= bands.differences(int(bands.of(largest)))


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_trees_lose_no_link(percent):
    draw = np.random.default_rng(percent)
    base = [np.unique(draw.integers(0, 2**63, int(n), dtype=np.uint64)) for n in draw.integers(1, 300, 40)]
    sets = [np.unique(np.concatenate([s[draw.random(len(s)) < keep], draw.integers(0, 2**63, extra, dtype=np.uint64)])) for s in base for keep, extra in ((1, 0), (0.97, 2), (0.9, 1))]
    sets = [s for s in sets if len(s)]
    bands = Bands(percent)
    linked = lambda a, b: bands.links(len(np.intersect1d(a, b)), len(a), len(b))
    found = {tuple(sorted(p)) for x, y in tree_join(sets, None, bands) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert found == {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if linked(sets[i], sets[j])}
    a, b = sets[:70], sets[70:]
    crossed = {p for x, y in tree_join(a, b, bands) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert crossed == {(i, j) for i in range(len(a)) for j in range(len(b)) if linked(a[i], b[j])}
    assert len(SignatureTree(sets, in_order(sets)).members[-1]) == 1


@pytest.mark.parametrize("grouped", [True, False])
def test_trees_drop_most_pairs(grouped):
    """Of a shard with many unrelated groups, nearly all pairs of leaves are dropped by the trees."""
    draw = np.random.default_rng(1)
    sets, groups = [], []
    for group in range(600):
        base = draw.integers(0, 2**63, int(np.exp(draw.uniform(3, 7))), dtype=np.uint64)
        for _ in range(draw.integers(2, 5)):
            sets.append(np.unique(base[draw.random(len(base)) < 0.99]))
            groups.append(group)
    tally, bands = {}, Bands(90)
    found = {tuple(sorted(p)) for x, y in tree_join(sets, None, bands, groups if grouped else None, tally) for p in zip(x.tolist(), y.tolist(), strict=True)}
    linked = lambda a, b: bands.links(len(np.intersect1d(a, b)), len(a), len(b))
    assert found == {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if groups[i] == groups[j] and linked(sets[i], sets[j])}
    assert tally["kept"] < (0.03 if grouped else 0.1) * tally["pairs"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 100), (None, 3)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000 - i) for i in range(1, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | dict.fromkeys((100, 101, 200), 100) | {i: 1000 for i in range(1000, 1300)} | {i: 4701 for i in range(4701, 5001)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in op2_jaccard_join(spark, sf_dir).collect()), key=repr)
    assert found == brute(docs, 3, 90)
