import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattica.llm.token_files import WordEncoder, checksums, op3_token_files, read_index, read_tokens, write_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)

pieces = st.sampled_from(["the", " ", "\n", "'s", "'", "É", "é", "é", "ẖ", "H̱", "İ", "漢", "１", "7", ".", ",", "!!", "%%%", "Th", "\x01", "́", "ß", "ſ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "‍"])


def expected(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.lists(pieces, max_size=10).map("".join), st.text(max_size=20)), max_size=4))
def test_same_ids_as_the_library(texts):
    assert [x.tolist() for x in ENCODER.encode(texts, 2)] == [expected(t) for t in texts]


def test_memo_starts_anew(monkeypatch):
    """Words of the memo before are found, also around special tokens."""
    from lattica.llm import token_files

    monkeypatch.setattr(token_files, "MEMO", 20)
    encoder = WordEncoder(PATH)
    for start in range(0, 300, 3):
        texts = [f"Word{i % 40}, other{i} <|endoftext|> É{i % 7} word{i % 40}. and" for i in range(start, start + 3)]
        assert [x.tolist() for x in encoder.encode(texts, 2)] == [expected(t) for t in texts]
    assert len(encoder.memo) + len(encoder.before) < 80


def test_special_tokens():
    texts = ["a <|endoftext|> b", "A<|startoftext|>B<|endoftext|><|endoftext|>", "<|EndOfText|>", "<|endoftext|>\u0338x", "x" * 50 + "<|endoftext|"]
    assert [x.tolist() for x in ENCODER.encode(texts, 2)] == [expected(t) for t in texts]
    assert expected(texts[0]) == [320, 49407, 321, 2]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(i, f"Text number {i}. Some words, more words! " * (i % 7), 0) for i in range(500)]
    rows += [(3, "a repeated id", 0), (3, "a repeated id", 0), (None, "no id", 0), (900, None, 0), (901, "", 0), (902, "long " * 300_000, 0)]
    path = str(tmp_path_factory.mktemp("tokens") / "files")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string, tokens int").repartition(5), path, PATH, 2)
    return path, rows


def test_round_trip(spark, written):
    path, rows = written
    found = checksums(spark, path).orderBy("start").collect()
    assert len(found) == len(rows)
    keys = [r["doc_id"] for r in found]
    assert keys == sorted(keys, key=lambda k: -1 if k is None else k)
    assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()
    by_key = {}
    for doc, text, _ in rows:
        ids = expected(text)
        by_key.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in found:
        by_key[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert not any(by_key.values())
    index = [(r["start"], r["n_tokens"]) for r in read_index(spark, path).orderBy("start").collect()]
    assert index == [(r["start"], r["n_tokens"]) for r in found]


def test_selective_reads(spark, written):
    path, _ = written
    part = read_tokens(spark, path, 10, 12)
    assert sorted(r["doc_id"] for r in part.collect()) == [10, 11, 12]
    assert "GreaterThanOrEqual(doc_id,10)" in part._jdf.queryExecution().executedPlan().toString()
    plan = read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan


def test_layout(written):
    path, _ = written
    import glob

    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
            assert any("DICTIONARY" in e for e in tokens.encodings) and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none", PATH, 2)
    assert checksums(spark, f"{tmp_path}/none").count() == 0


def test_query(spark, sf_dir):
    found = {r["doc_id"]: r for r in op3_token_files(spark, sf_dir).collect()}
    start = 0
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = expected(doc["text"])
        r = found[doc["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
