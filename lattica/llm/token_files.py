"""Token-id output: Parquet files of id lists in ascending key order, and selective reads of them.

Ids are written as a list column with a dictionary (16 bits or fewer an id after bit packing), keys and counts
with delta encoding. Row groups and pages have stated sizes, and pages carry indexes, so a reader of a few
documents, or of counts alone, fetches little more than those.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import list_array, new_path, shuffle_width, slices, small_batches, table
from lattica.operators.grid import step_of

#: Remembered words of a worker before it starts anew; the words before are kept as long again, and those still met stay.
MEMO = 600_000
#: Marks that never belong to the same pre-token as a letter or digit before them.
MARKS = b".,;:!?%&*#$"
#: Stands between words that are encoded together.
BETWEEN = b" \x01 "
MARK_LIST = [bytes([mark]) for mark in MARKS]
BORDER = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,;:!?%&*#$])")
#: Kinds of bytes: letters and digits (a), white space, marks (.), other ASCII (-), beyond ASCII (x).
KINDS = bytes(ord("x" if i > 127 else "a" if chr(i).isalnum() else " " if i in b" \t\n\r\v\f" else "." if i in MARKS else "-") for i in range(256))
#: How the files are laid out.
LAYOUT = {
    "compression": "snappy",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_shard": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


class WordEncoder:
    """The tokenizers library's ids, remembered by word.

    The tokenizer drops white space before it merges, so a text's ids are those of the runs between ASCII
    white space, one after another. It also ignores the case of ASCII letters (where no combining mark follows
    that could compose with one case only), and parts a letter or digit from marks behind it. Words are therefore
    looked up in lower case, and those not yet known without the marks at their end. Special tokens are found in
    the text as it is written, as the library does; what stands between them is encoded apart.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(x.normalized or x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError("special tokens that take more than their own letters are not supported")
        self.special = {x.content.encode(): struct.pack("<i", i) for i, x in added.items()}
        self.cut = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + b")")
        # Words are looked up in lower case, where other strings could turn into special ones.
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        ids = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self.between = ids[0] if len(ids) == 1 else -1
        self.normalizer = self.tokenizer.normalizer

    def learn(self, words: list[bytes]) -> None:
        """Encodes words of ASCII letters in lower case, which the normalizer would leave as they are, without it; others with it."""
        plain = [w for w in words if w.isascii() and w == w.lower()]
        if plain and self.normalizer is not None:
            self.tokenizer.normalizer = None
            try:
                self.learn_alike(plain)
            finally:
                self.tokenizer.normalizer = self.normalizer
            words = [w for w in words if w not in self.memo]
        if words:
            self.learn_alike(words)

    def learn_alike(self, words: list[bytes]) -> None:
        """Encodes words at once, with a mark between them that is a token of its own, or else one by one."""
        data = BETWEEN.join(words)
        if data.count(BETWEEN) == len(words) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids, "<i4")
            cuts = np.flatnonzero(ids == self.between).tolist()
            if len(cuts) == len(words) - 1:
                packed = ids.tobytes()
                for word, a, b in zip(words, [-1, *cuts], [*cuts, len(ids)], strict=True):
                    self.memo[word] = packed[4 * a + 4 : 4 * b]
                return
        for word, found in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.memo[word] = struct.pack(f"<{len(found.ids)}i", *found.ids)

    def around_special(self, data: bytes) -> list[bytes]:
        """The ids of a text that has special tokens: of these, and of what stands between them."""
        return [self.special[x] if x in self.special else self.packed([x], None)[0] for x in self.cut.split(data) if x]

    def encode(self, texts: list[str | bytes | None], end_id: int) -> list[np.ndarray]:
        return [np.frombuffer(x, "<i4") for x in self.packed(texts, end_id)]

    def packed(self, texts: list[str | bytes | None], end_id: int | None) -> list[bytes]:
        """Each text's ids and the end's, if any, as little-endian 32-bit integers. Texts may be given in UTF-8."""
        if len(self.memo) > MEMO and end_id is not None:  # not in the middle of a text
            self.memo, self.before = {}, self.memo
        memo, before, found, waiting, fresh = self.memo, self.before, [], [], set()
        for text in texts:
            data = text if isinstance(text, bytes) else (text or "").encode()
            if any(x in data for x in self.special):
                found.append(self.around_special(data))
                continue
            if b"\xcc" not in data and b"\xcd" not in data:
                data = data.lower()
            kinds = data.translate(KINDS)
            if b".." in kinds or b"-." in kinds or (b"x." in kinds and not letters_alone(data)):
                words = BORDER.sub(b" ", data).split()
            else:  # every mark follows a letter, a digit or white space
                for mark in MARK_LIST:
                    if mark in data:
                        data = data.replace(mark, b" " + mark)
                words = data.split()
            own = list(map(memo.get, words))
            found.append(own)
            i = -1
            for _ in range(own.count(None)):
                i = own.index(None, i + 1)
                word = words[i]
                if before and (known := before.get(word)) is not None:
                    own[i] = memo[word] = known
                    continue
                if word[-1] not in MARKS:
                    waiting.append((own, i, word, b""))
                    fresh.add(word)
                    continue
                body = word.rstrip(MARKS)
                if len(body) == len(word) or not body[-4:].decode(errors="ignore").lower()[-1:].isalnum():
                    body = word
                marks = word[len(body) :]
                if body in memo and (not marks or marks in memo):
                    own[i] = memo[body] + memo[marks] if marks else memo[body]
                else:
                    waiting.append((own, i, body, marks))
                    fresh.update((body, marks) if marks else (body,))
        fresh = [w for w in fresh if w not in memo]
        for at in range(0, len(fresh), 4096):
            self.learn(fresh[at : at + 4096])
        for own, i, body, marks in waiting:
            own[i] = memo[body] + memo[marks] if marks else memo[body]
        end = b"" if end_id is None else struct.pack("<i", end_id)
        for own in found:
            own.append(end)
        return list(map(b"".join, found))


def letters_alone(data: bytes) -> bool:
    """Whether all characters beyond ASCII are letters, also in lower case."""
    rest = data.translate(None, bytes(range(128))).decode()
    return rest.isalpha() and "İ" not in rest


@functools.lru_cache(2)
def worker_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that later tasks find its memo filled."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", layout: dict | None = None) -> None:
    """Encodes each whole text (null: empty), appends end_id and writes the files in ascending key order.

    Null keys come first; rows that repeat a key are all kept, ordered by a hash of their texts. Other columns
    are left out, whatever their names. One shuffle, of texts, by ranges of the key; an empty table makes files
    without rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start, shard = worker_encoder(tokenizer_path), 0, TaskContext.get().partitionId()
        for batch in slices(batches):
            found = encoder.packed(batch.column(1).cast(pa.binary()).to_pylist(), end_id)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            ids = np.frombuffer(b"".join(found), "<i4")
            ends = start + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(sizes), shard, np.int32)), pa.array(ends - sizes), pa.array(sizes), list_array(ids, sizes, pa.int32())],
                names=["doc_id", "shard", "start_in_shard", "n_tokens", "tokens"],
            )
            start = int(ends[-1])

    rows = small_batches(docs).select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # The ranges come from the keys alone: a range partitioner would sample whole rows, and read all texts twice.
    parts = shuffle_width(docs.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("cuts")).first()["cuts"] if shares else None
    cuts = sorted(set(found or ()))
    at = F.coalesce(step_of(F.col("doc_id"), [cuts[0], *cuts]), F.lit(0)) if cuts else F.lit(0)
    ranged = rows.repartitionById(parts, at).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(run, f"doc_id {kind}, shard int, start_in_shard bigint, n_tokens bigint, tokens array<int>").write.options(**(LAYOUT | (layout or {}))).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without a look at any id."""
    rows = spark.read.parquet(path).select("doc_id", "shard", "start_in_shard", "n_tokens")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    before = totals.select("shard", (F.sum("in_shard").over(W.orderBy("shard")) - F.col("in_shard")).alias("before"))
    # One row for each file: their number is that of the writer's partitions.
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "shard", "start_in_shard")


def read_tokens(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """doc_id and tokens of the keys from first to last; page indexes limit what is read."""
    rows = spark.read.parquet(path).select("doc_id", "tokens")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, as read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(), "<i4")
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            found = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found, pa.array(crc, pa.int64())], names=["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"])

    stored = small_batches(spark.read.parquet(path))
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("doc_id", "shard", "start_in_shard", "tokens").mapInArrow(run, f"doc_id {kind}, shard int, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint")
    totals = stored.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    before = totals.select("shard", (F.sum("in_shard").over(W.orderBy("shard")) - F.col("in_shard")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return checksums(spark, path)
