import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.mixing import fit_budget, knapsack, mix, op6_mix, share_out, word_sizes


def best_sum(lengths, counts, budget):
    sums = {0}
    for length, count in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(count + 1) if s + k * length <= budget}
    return max(sums)


lengths_and_counts = st.lists(st.tuples(st.integers(1, 12), st.integers(0, 4)), max_size=5, unique_by=lambda x: x[0])


@settings(max_examples=200, deadline=None)
@given(lengths_and_counts, st.integers(0, 60))
def test_knapsack_is_exact(pairs, budget):
    lengths, counts = [a for a, _ in pairs], [n for _, n in pairs]
    taken = knapsack(lengths, counts, budget)
    assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
    assert sum(a * t for a, t in zip(lengths, taken, strict=True)) == best_sum(lengths, counts, budget)


@settings(max_examples=100, deadline=None)
@given(lengths_and_counts, st.integers(0, 120), st.integers(1, 30))
def test_budget_is_met_as_well_as_the_window_allows(pairs, budget, window):
    lengths, counts = [a for a, _ in pairs], [n for _, n in pairs]
    taken = fit_budget(lengths, counts, budget, window)
    got = sum(a * t for a, t in zip(lengths, taken, strict=True))
    assert all(0 <= t <= n for t, n in zip(taken, counts, strict=True))
    assert got <= max(budget, 0) or got == sum(a * n for a, n in pairs)
    if budget <= window:
        assert got == best_sum(lengths, counts, budget)


def test_large_budget_is_hit_exactly():
    lengths, counts = list(range(1, 3000)), [7] * 2999
    total = sum(a * n for a, n in zip(lengths, counts, strict=True))
    for budget in (total // 3, total - 5, 12_345):
        taken = fit_budget(lengths, counts, budget)
        assert sum(a * t for a, t in zip(lengths, taken, strict=True)) == budget


def test_shares():
    assert share_out([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert share_out([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert share_out([0, 0], [5, 2]) == [0.0, 0.0] and share_out([], []) == []
    found = share_out([1, 50, 900, 3], [5, 2, 1, 5])
    assert sum(found) == pytest.approx(954) and all(t <= 3 * s for t, s in zip(found, [1, 50, 900, 3], strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 3}", 0) for i in range(600)]
    rows += [(1000 + i, "a b c", None, 0) for i in range(30)] + [(2000, None, "s0", 0), (2001, "", "é", 0), (None, "x y", "s1", 0), (None, "x y", "s1", 0), (5, "five again", "s2", 0), (3000, "long " * 100_000, "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_sizes(docs):
    sizes = {(r["doc_id"], r["source"]): r["size"] for r in word_sizes(docs).collect()}
    assert sizes[2000, "s0"] == 0 and sizes[1000, None] == 3 and sizes[39, "s0"] == 39 and sizes[3000, "z"] == 100_000


def test_mix(docs):
    found = mix(word_sizes(docs.repartition(7))).collect()
    assert len(found) == docs.count()
    sources = sorted({r["source"] for r in found if r["source"] is not None}) + [None]
    sizes = [sum(r["size"] for r in found if r["source"] == s) for s in sources]
    targets = share_out(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))])
    for source, size, target in zip(sources, sizes, targets, strict=True):
        own = [r for r in found if r["source"] == source]
        assert {r["source_size"] for r in own} == {size} and {r["target"] for r in own} == {target}
        assert all(0 <= r["times"] <= 3 for r in own)
        assert abs(sum(r["times"] * r["size"] for r in own) - target) <= max(2, min(r["size"] for r in own if r["size"]) if size else 0) or source == "z"
    again = mix(word_sizes(docs.repartition(3))).collect()
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["size"], r["times"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_other_seeds_take_others(spark):
    sized = spark.range(300).selectExpr("id as doc_id", "cast(id % 3 as string) as source", "5 + id % 7 as size")
    one, two = (sorted((r["doc_id"], r["times"]) for r in mix(sized, seed=s).collect()) for s in (1, 2))
    assert one != two


def test_empty_table(docs):
    assert mix(word_sizes(docs.where("doc_id < 0"))).collect() == []


def test_hot_length_is_cut_by_buckets(spark):
    sized = spark.range(5000).selectExpr("id as doc_id", "if(id < 4000, 'a', 'b') as source", "cast(7 as bigint) as size")
    found = mix(sized).collect()
    for source in "ab":
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["times"] * 7 for r in own) - own[0]["target"]) <= 7


def test_query(spark, sf_dir):
    found = op6_mix(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(found.doc_id) == sorted(docs.doc_id)
    merged = found.merge(docs, on="doc_id")
    assert (merged["size"] == [len((t or "").encode().split()) for t in merged.text]).all()
    assert (merged.taken <= 3 * merged["size"]).all() and merged.target.groupby(merged.source).first().sum() == pytest.approx(merged["size"].sum())
    sums = merged.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    # No subset of a short source comes nearer than its shortest document allows.
    assert (sums.taken <= sums.target + 1).all() and (abs(sums.taken - sums.target) <= 0.05 * sums.target).all()
    assert list(itertools.islice(merged.columns, 5)) == ["doc_id", "size", "source_size", "target", "taken"]
