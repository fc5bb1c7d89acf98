"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

Leaves hold the characters and tokens of runs of pre-tokens, inner nodes their sums, the root the document's
counts. An edit finds its place by the sums, matches the pattern again from a little before it until a match ends
where one ended before, encodes the pre-tokens between, and updates the sums on the way to the root.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import list_array, slices, small_batches, table

#: Pre-tokens of a leaf (up to twice as many after edits), children of an inner node.
LEAF, FAN_OUT = 256, 16
#: Pre-tokens that are matched again before an edit: white space looks one character ahead.
CONTEXT = 2
MEMO = 500_000


class PieceCounter:
    """Splits texts into pre-tokens and counts the tokens of each, remembered by pre-token."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        from lattica.llm.byte_bpe import load_ranks

        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.memo: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            n = self.memo[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the pre-tokens of a whole text."""
        found = self.pattern.findall(text)
        counts = list(map(self.memo.get, found))
        if None in counts:
            counts = [self(piece) if n is None else n for piece, n in zip(found, counts, strict=True)]
        return np.fromiter(map(len, found), np.int32, len(found)), np.array(counts, np.int32)


@functools.lru_cache(2)
def worker_counter(ranks_path: str, pattern: str) -> PieceCounter:
    """One for all tasks of a Python worker."""
    return PieceCounter(ranks_path, pattern)


class PretokenTree:
    """A text, its leaves (characters and tokens of pre-tokens) and levels of sums; the last level is the root."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text = text
        cuts = range(LEAF, len(chars), LEAF)
        self.leaves = list(zip(np.split(chars, cuts), np.split(tokens, cuts), strict=True))
        self.encoded_pieces = self.encoded_chars = 0
        self.build()

    def build(self) -> None:
        """All sums above the leaves."""
        self.levels = [np.array([[c.sum(), t.sum(), len(c)] for c, t in self.leaves], np.int64).reshape(-1, 3)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.add.reduceat(below, np.arange(0, len(below), FAN_OUT)))

    def refresh(self, leaf: int) -> None:
        """The sums on the way from a leaf to the root."""
        c, t = self.leaves[leaf]
        self.levels[0][leaf] = c.sum(), t.sum(), len(c)
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            leaf //= FAN_OUT
            level[leaf] = below[leaf * FAN_OUT : (leaf + 1) * FAN_OUT].sum(0)

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1]) if len(self.levels[-1]) else 0

    def place(self, char: int) -> tuple[int, int, int]:
        """Leaf, pre-token within it and the pre-token's first character, of the first pre-token that ends at or after char."""
        node, start = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= FAN_OUT
            last = min(node + FAN_OUT, len(level)) - 1
            while node < last and start + level[node, 0] < char:
                start += int(level[node, 0])
                node += 1
        chars = self.leaves[node][0]
        ends = start + np.cumsum(chars)
        at = min(int(np.searchsorted(ends, char)), max(0, len(chars) - 1))
        return node, at, int(ends[at] - chars[at]) if len(chars) else start

    def back(self, leaf: int, at: int, start: int, n: int) -> tuple[int, int, int]:
        """n pre-tokens earlier, or the first."""
        while n and (leaf or at):
            if not at:
                leaf -= 1
                at = len(self.leaves[leaf][0])
            at -= 1
            start -= int(self.leaves[leaf][0][at])
            n -= 1
        return leaf, at, start

    def old_ends(self, leaf: int, at: int, start: int) -> Iterator[tuple[int, int, int]]:
        """The end of each pre-token from there on, with its leaf and the place after it."""
        for i in range(leaf, len(self.leaves)):
            for j, n in enumerate(self.leaves[i][0][at:].tolist(), at + 1):
                start += n
                yield start, i, j
            at = 0

    def replace(self, pos: int, length: int, new: str, counter: PieceCounter) -> None:
        """Puts new in the place of length characters from pos on; both are held within the text."""
        pos = max(0, min(pos, len(self.text)))
        end = min(len(self.text), pos + max(0, length))
        grown = len(new) - (end - pos)
        self.text = self.text[:pos] + new + self.text[end:]
        if not self.leaves:
            chars, tokens = counter.pieces(self.text)
            self.encoded_pieces += len(chars)
            self.encoded_chars += len(self.text)
            self.__dict__.update(leaves=PretokenTree(self.text, chars, tokens).leaves)
            self.build()
            return
        leaf, at, start = self.back(*self.place(pos), CONTEXT)
        old = self.old_ends(leaf, at, start)
        old_end, last, after = start, leaf, at
        chars, tokens = [], []
        meets = False
        for match in counter.pattern.finditer(self.text, start):
            chars.append(match.end() - match.start())
            tokens.append(counter(match.group()))
            back = match.end() - grown
            if back >= end:
                while old_end < back:
                    old_end, last, after = next(old)
                if old_end == back:
                    meets = True
                    break
        self.encoded_pieces += len(chars)
        self.encoded_chars += sum(chars)
        if not meets:  # the new text ends before a border is met again: all that stood behind is gone
            last, after = len(self.leaves) - 1, len(self.leaves[-1][0])
        first, rest = self.leaves[leaf], self.leaves[last]
        joined = [np.concatenate([first[k][:at], np.array(x, np.int32), rest[k][after:]]) for k, x in ((0, chars), (1, tokens))]
        if leaf == last and 0 < len(joined[0]) <= 2 * LEAF:
            self.leaves[leaf] = (joined[0], joined[1])
            self.refresh(leaf)
        else:
            cuts = range(LEAF, len(joined[0]), LEAF)
            self.leaves[leaf : last + 1] = [x for x in zip(*(np.split(v, cuts) for v in joined), strict=True) if len(x[0])]
            self.build()


def tree_of(text: str, counter: Callable) -> PretokenTree:
    return PretokenTree(text, *counter.pieces(text))


def build_trees(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, text, piece_chars, piece_tokens: the leaves to be kept with each document, for later edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(ranks_path, pattern)
        for batch in slices(batches):
            found = [counter.pieces(x or "") for x in batch.column(1).to_pylist()]
            sizes = [len(c) for c, _ in found]
            leaves = [list_array(np.concatenate([x[k] for x in found]), sizes, pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *leaves], names=["doc_id", "text", "piece_chars", "piece_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, text string, piece_chars array<int>, piece_tokens array<int>")


def edit_counts(rows: DataFrame, ranks_path: str, pattern: str, keep: bool = False) -> DataFrame:
    """doc_id, tokens_before, n_edits, tokens_after, chars_after, pieces_encoded, chars_encoded for each row.

    rows: doc_id, text, edits (array of structs pos, length, text, applied in turn; places count characters of the
    text as the edits before left it and are held within it) and, if they were kept, piece_chars and piece_tokens.
    With keep, the edited text and its leaves are returned too. A null text is empty; null edits are none, and a
    null within an edit counts as 0 or as no text. pieces_encoded and chars_encoded tell what the edits cost. Other
    columns are left out. Every row is answered by itself, so ids may be null or repeat.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    kept = [c for c in ("piece_chars", "piece_tokens") if c in rows.columns]
    leaves = ["piece_chars", "piece_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(ranks_path, pattern)
        for batch in slices(batches):
            out, trees = [], []
            own = zip(*(batch.column(c).to_pylist() for c in kept), strict=True) if kept else iter([None] * batch.num_rows)
            for text, edits, found in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), own, strict=True):
                text = text or ""
                if found and None not in found:
                    tree = PretokenTree(text, *(np.array(x, np.int32) for x in found))
                else:
                    tree = tree_of(text, counter)
                before, edits = tree.tokens, [e for e in edits or () if e]
                for edit in edits:
                    tree.replace(edit["pos"] or 0, edit["length"] or 0, edit["text"] or "", counter)
                out.append((before, len(edits), tree.tokens, len(tree.text), tree.encoded_pieces, tree.encoded_chars))
                if keep:
                    trees.append((tree.text, *(np.concatenate([x[k] for x in tree.leaves]) if tree.leaves else np.zeros(0, np.int32) for k in (0, 1))))
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))]
            if keep:
                columns += [pa.array([x[0] for x in trees]), *(list_array(np.concatenate([x[k] for x in trees]), [len(x[k]) for x in trees], pa.int32()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    counts = ["tokens_before", "n_edits", "tokens_after", "chars_after", "pieces_encoded", "chars_encoded"]
    names = ["doc_id", *counts, *(["text", *leaves] if keep else [])]
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + (", text string, piece_chars array<int>, piece_tokens array<int>" if keep else "")
    return small_batches(rows).select("doc_id", F.col("text").cast("string").alias("text"), "edits", *kept).mapInArrow(run, schema)


def seeded_edits(doc_id, text, n: int = 4):
    """n edits that follow from the id and the text's length: an insertion, a deletion, a replacement, an append-like one, in turn."""
    words = F.array(*[F.lit(x) for x in (" the new", "", "1,234\n", "  of'")])

    def draw(i, salt: int, below):
        return F.pmod(F.xxhash64(doc_id, i, F.lit(salt)), below)

    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(
            draw(i, 1, F.coalesce(F.length(text), F.lit(0)) + 1).alias("pos"),
            F.when(i % 4 == 0, F.lit(0)).otherwise(draw(i, 2, F.lit(24))).cast("bigint").alias("length"),
            F.element_at(words, (i % 4 + 1).cast("int")).alias("text"),
        ),
    )


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edit_counts(docs.withColumn("edits", seeded_edits(F.col("doc_id"), F.col("text"))), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
