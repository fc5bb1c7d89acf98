"""Byte-level BPE: exact merges by longest matches and backtracking, in time linear in the text.

An Aho-Corasick automaton over Latin-1 images of the vocabulary's bytes lists every token that starts at
each byte of a pre-token. The encoder takes the longest and moves on; two neighbours may stand side by side
only if the merges would leave the border between them open, which is memoised for each pair of tokens. Where
no token fits, it steps back and tries a shorter one. A prefix has one encoding only, so an end that was given
up never needs a second visit.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import list_array, slices, small_batches, table

#: Entries that a worker's memos hold before they start anew.
MEMO = 350_000
PAIRS = 400_000
#: White space other than ASCII's, white space beside white space or at an end, and places for cuts in UTF-8.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
GAP = re.compile(rb"\s\s|\A\s|\s\Z")
SPACE = re.compile(rb"(?<=\S) (?=\S)")
LINE = re.compile(rb"(?<=\S)\n(?=\S)")
BORDER = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,;:!?%&*#$|])")
#: Fixed value: the one pattern whose matches are known not to reach across such places.
CUT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encodes as the ranks' merges do, each match of the pattern by itself; no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        top = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.size_of = list(map(len, self.bytes_of))
        self.find = regex.compile(pattern).findall
        self.may_cut = pattern == CUT_PATTERN
        self.odd_space = ODD_SPACE.search
        self.gap = GAP.search
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.trie.make_automaton()
        self.prefix: list[int | None] = [None] * top
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.memo: dict[bytes, bytes] = {}
        self.said = list(map(str, range(top)))

    def merged(self, piece: bytes, whole: bool = True) -> list[bytes]:
        """Plain merging, lowest rank first. With whole False, the last two parts of a token stay apart."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None or (not whole and len(parts) == 2):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token that merges never make."""
        if token not in self.parts:
            made = self.merged(self.bytes_of[token], whole=False) if self.size_of[token] > 1 else []
            pair = tuple(self.ranks.get(x, -1) for x in made)
            self.parts[token] = pair if len(pair) == 2 and -1 not in pair else None
        return self.parts[token]

    def border_stays(self, left: int, right: int) -> bool:
        """Whether the merges that make left and right, side by side, never join bytes across their border."""
        limit = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two last merges; what joins across must then have come before it.
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.prefix[token]
        if found is None:
            own = self.bytes_of[token]
            found = self.prefix[token] = next((self.ranks[own[:n]] for n in range(len(own) - 1, 0, -1) if own[:n] in self.ranks), -1)
        return found

    def may_follow(self, last: int, token: int) -> bool:
        """Whether merges make this token at all, and leave its border with the last one (-1: none) open."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        good = self.fits[last << 24 | token] = (self.size_of[token] == 1 or self.halves(token) is not None) and (last < 0 or self.border_stays(last, token))
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size_of, known, n = self.size_of, self.fits.get, len(piece)
        longest = [-1] * n
        for end, token in self.trie.iter(piece.decode("latin-1")):
            longest[end + 1 - size_of[token]] = token
        out: list[int] = []
        last, pos, given_up, token = -1, 0, 0, longest[0]
        while True:
            while token >= 0:
                end = pos + size_of[token]
                if not given_up >> end & 1:
                    good = known(last << 24 | token)
                    if self.may_follow(last, token) if good is None else good:
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                last, pos, token = token, end, longest[end]
            elif out:
                given_up |= 1 << pos
                pos -= size_of[last]
                token = self.shorter(out.pop())
                last = out[-1] if out else -1
            else:  # bytes without a token of their own
                return [self.ranks[x] for x in self.merged(piece)]

    def encoded(self, chunk: str) -> bytes:
        ids = [i for piece in self.find(chunk) for i in self.encode_piece(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def decimals(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by a space."""
        return " ".join(map(self.said.__getitem__, ids.tolist()))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text.

        The text is cut where no match of the pattern reaches across, and what pieces encode to is remembered:
        before a space and around a line break that stand between other characters, and between a letter or
        digit and a mark. Texts with white space beyond ASCII, and all texts where the pattern is another one, are
        matched as a whole.
        """
        if not self.may_cut or self.odd_space(text):
            pieces = [x.encode() for x in self.find(text)]
        else:
            data = text.encode()
            if self.gap(data):
                data = LINE.sub(b"\xff\n\xff", SPACE.sub(b"\xff ", data))
            else:
                data = data.replace(b" ", b"\xff ").replace(b"\n", b"\xff\n\xff")
            pieces = BORDER.sub(b"\xff", data).split(b"\xff") if data else []
        memo = self.memo
        out = list(map(memo.get, pieces))
        if None in out:
            if len(memo) >= MEMO:
                memo.clear()
            for i, found in enumerate(out):
                if found is None:
                    piece = pieces[i]
                    found = memo.get(piece)
                    if found is None:
                        found = memo[piece] = self.encoded(piece.decode())
                    out[i] = found
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@functools.lru_cache(2)
def worker_bpe(ranks_path: str, pattern: str) -> ByteBPE:
    """One encoder for all tasks of a Python worker, so that later tasks find its memos filled."""
    return ByteBPE(load_ranks(ranks_path), pattern)


FIELDS = {"ids": "array<int>", "n_tokens": "bigint", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, outputs=("ids", "n_tokens"), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the named outputs (see FIELDS) for each row; other columns are left out, whatever their names.

    A null text counts as empty: no ids, 0 tokens, digests of nothing. Keys may be null or repeat; each row is
    answered by itself, however long its text. One pass without a shuffle; a worker keeps one bounded memo.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path, pattern)
        for batch in slices(batches):
            ids, columns = [], {name: [] for name in outputs}
            for value in batch.column(1).to_pylist():
                own = bpe.encode(value or "")
                if "ids" in columns:
                    ids.append(own)
                if "n_tokens" in columns:
                    columns["n_tokens"].append(len(own))
                if "ids_sha256" in columns:
                    columns["ids_sha256"].append(hashlib.sha256(bpe.decimals(own).encode()).hexdigest())
                if "decoded" in columns or "decoded_sha256" in columns:
                    back = bpe.decode(own)
                    if "decoded" in columns:
                        columns["decoded"].append(back)
                    if "decoded_sha256" in columns:
                        columns["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            arrays = []
            for name in outputs:
                if name == "ids":
                    arrays.append(list_array(np.concatenate(ids).astype(np.int32), [len(x) for x in ids], pa.int32()))
                else:
                    arrays.append(pa.array(columns[name], {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[FIELDS[name]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *outputs])

    return small_batches(docs).select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{x} {FIELDS[x]}" for x in outputs))


def decode_documents(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The key and the bytes that the ids stand for; null ids decode to no bytes."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = dict(map(reversed, load_ranks(ranks_path).items()))
        for batch in slices(batches):
            out = [b"".join(map(bytes_of.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return small_batches(encoded).select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, decoded binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
