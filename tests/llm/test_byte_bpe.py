import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.byte_bpe import ByteBPE, decode_documents, encode_documents, load_ranks, op8_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = load_ranks(PATH)
BPE = ByteBPE(RANKS, PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})

pieces = st.sampled_from(["the", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "é", "漢", "😀", "１", "2", ".", "...", "!?", "Th", "ation", "\x1c", "\x85", "\xa0", " ", "-", "x" * 40, "́"])
texts = st.one_of(st.lists(pieces, max_size=14).map("".join), st.text(max_size=40))


@settings(max_examples=600, deadline=None)
@given(texts)
def test_same_ids_as_the_library(text):
    ids = BPE.encode(text)
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert BPE.decimals(ids) == " ".join(map(str, ids.tolist()))
    assert BPE.decode(ids) == text.encode()


@pytest.mark.parametrize("pattern", [r"\S+\s*|\s+", r"[\s\S]{1,7}", r"\p{L}+\p{P}?|[^\p{L}]+"])
def test_other_patterns(pattern):
    """No cuts but the pattern's own: these matches reach across spaces and marks."""
    mine, theirs = ByteBPE(RANKS, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    assert BPE.may_cut and not mine.may_cut
    for text in ("one two, three.four\nfive", "a. b", "the end of  it!? yes"):
        assert mine.encode(text).tolist() == theirs.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_pieces_by_plain_merging(piece):
    expected = [RANKS[piece]] if piece in RANKS else [RANKS[x] for x in BPE.merged(piece)]
    assert BPE.encode_piece(piece) == expected


def test_small_vocabulary_steps_back():
    """The longest match first is wrong here: 'ab' is merged before 'bc', and 'abcd' is no token."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"cd": 258, b"bcd": 259}
    bpe = ByteBPE(ranks, r"\w+")
    for text in ("abcd", "abc", "bcd", "abab", "cdab", "bbcdd"):
        assert bpe.encode_piece(text.encode()) == ([ranks[text.encode()]] if text.encode() in ranks else [ranks[x] for x in bpe.merged(text.encode())])


@pytest.fixture(scope="module")
def docs(spark):
    long = "word " * 200_000
    rows = [(1, "The theory's 42 things!\n\nNew  line", "x"), (2, None, "x"), (3, "", "x"), (None, "no id", "x"), (1, "a repeated id", "x"), (5, long, "x"), (6, "ids \t tabs", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_rows_of_all_kinds(docs):
    out = encode_documents(docs, PATH, PATTERN, ("ids", "n_tokens", "decoded"))
    found = sorted((r["doc_id"] or -1, r["n_tokens"], bytes(r["decoded"])) for r in out.collect())
    assert found == sorted((r["doc_id"] or -1, len(REFERENCE.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect())
    again = decode_documents(out, PATH)
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted(x for _, _, x in found)


def test_empty_table(docs):
    assert encode_documents(docs.where("doc_id > 99"), PATH, PATTERN).collect() == []


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in op8_byte_bpe(spark, sf_dir).collect()}
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = REFERENCE.encode_ordinary(doc["text"] or "")
        row = rows[doc["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()
