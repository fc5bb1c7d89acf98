import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.llm import edit_counts as E

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
COUNTER = E.PieceCounter(PATH, PATTERN)

pieces = st.sampled_from(["the", " ", "  ", "\n", "\t", "'s", "'", "é", "漢", "1", ".", "...", "Th", "\x85", "ing"])
texts = st.lists(pieces, max_size=25).map("".join)
edits = st.lists(st.tuples(st.integers(-2, 60), st.integers(0, 20), texts), max_size=5)


def whole(text):
    return len(COUNTER.encoding.encode_ordinary(text))


@pytest.mark.parametrize("leaf", [2, 256])
def test_edits_against_whole_counts(leaf, monkeypatch):
    monkeypatch.setattr(E, "LEAF", leaf)
    monkeypatch.setattr(E, "FAN_OUT", 2)

    @settings(max_examples=300, deadline=None)
    @given(texts, edits)
    def check(text, changes):
        tree = E.tree_of(text, COUNTER)
        for pos, length, new in changes:
            at = max(0, min(pos, len(text)))
            text = text[:at] + new + text[at + length :]
            tree.replace(pos, length, new, COUNTER)
            assert tree.text == text and tree.tokens == whole(text)
            assert [n for c, _ in tree.leaves for n in c.tolist()] == [len(p) for p in COUNTER.pattern.findall(text)]

    check()


def test_only_the_place_of_an_edit_is_encoded():
    text = "Some words and more of them. " * 5000
    tree = E.tree_of(text, COUNTER)
    tree.replace(70_000, 3, "new", COUNTER)
    assert tree.encoded_pieces < 12 and tree.encoded_chars < 80 and tree.tokens == whole(tree.text)


@pytest.fixture(scope="module")
def rows(spark):
    change = [(0, 0, "The "), (10**9, 5, " end"), (3, None, None)]
    data = [(1, "Some text here", change), (2, None, change), (3, "", None), (None, "no id", [None, (1, 1, "")]), (1, "a repeated id", []), (5, "long words " * 50_000, [(200_000, 7, "\n")])]
    return spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, edits array<struct<pos:bigint,length:bigint,text:string>>, n_edits string")


def after(text, changes):
    text = text or ""
    for e in [e for e in changes or [] if e]:
        at = max(0, min(e["pos"] or 0, len(text)))
        text = text[:at] + (e["text"] or "") + text[at + (e["length"] or 0) :]
    return text


def test_odd_rows(rows):
    found = E.edit_counts(rows, PATH, PATTERN, keep=True).collect()
    expected = [(r["doc_id"], whole(r["text"] or ""), whole(t := after(r["text"], r["edits"])), len(t), t) for r in rows.collect()]
    key = lambda r: (r[0] or -1, r[4])
    assert sorted(((r["doc_id"], r["tokens_before"], r["tokens_after"], r["chars_after"], r["text"]) for r in found), key=key) == sorted(expected, key=key)
    assert all(sum(r["piece_tokens"]) == r["tokens_after"] and sum(r["piece_chars"]) == r["chars_after"] for r in found)


def test_kept_trees(rows):
    trees = E.build_trees(rows, PATH, PATTERN)
    change = F.array(F.struct(F.lit(2).alias("pos"), F.lit(1).alias("length"), F.lit("XY").alias("text")))
    found = E.edit_counts(trees.withColumn("edits", change), PATH, PATTERN, keep=True)
    for r in found.collect():
        assert r["tokens_after"] == whole(r["text"])
    again = E.edit_counts(found.withColumn("edits", change), PATH, PATTERN)
    assert sorted(r["tokens_before"] for r in again.collect()) == sorted(r["tokens_after"] for r in found.collect())


def test_empty_table(rows):
    assert E.edit_counts(rows.where("doc_id > 99"), PATH, PATTERN).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = {r["doc_id"]: r for r in docs.withColumn("edits", E.seeded_edits(F.col("doc_id"), F.col("text"))).collect()}
    for r in E.op5_edit_counts(spark, sf_dir).collect():
        doc = made[r["doc_id"]]
        text = after(doc["text"], doc["edits"])
        assert (r["tokens_before"], r["tokens_after"], r["chars_after"], r["n_edits"]) == (whole(doc["text"] or ""), whole(text), len(text), 4)
