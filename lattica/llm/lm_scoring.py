"""Language-model scores by a weighted backoff automaton.

The model smooths n-grams towards shorter ones: P(w | h) = (c(h w) + k P(w | h')) / (c(h) + k), where h' is h without
its first word, and words by their frequencies. As an automaton it has a state for each history of the training
texts, one for the start of a text and a root. A seen n-gram is an arc with its smoothed probability; where there is
none, the failure arc of the state leads to the state of the shorter history at the price log10(k / (c(h) + k)), and
the root knows every word. A text is scored by one traversal from left to right, which carries the state.

No machine ever holds the model. Documents go in batches; a batch asks for the counts of its own distinct words and
n-grams, dealt by hash to shards that add up what all batches report; with the shards' answers it builds the part of
the automaton that its texts can reach, and runs it. Batches are bounded by bytes, and shards grow in number, not in
size, with the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import held_out, shuffle_width, slices, small_batches, stash, table
from lattica.llm.words import A, lower_words, mix, word_hashes

#: For each order from bigrams on, the weight of the shorter history within an n-gram's probability.
WEIGHTS = (300.0,)
#: Rows of a batch of texts of at most SHORT bytes. Texts up to four times as long go in batches of a quarter of the
#: rows, and so on: no batch has more than ROWS * SHORT bytes, but for single texts that are longer.
ROWS, SHORT, KINDS = 2048, 16_384, 7
#: Bytes of input for each shard of counts, and partitions at most; a worker holds one shard, or one batch, at a time.
SHARD_BYTES, PARTS = 32 << 20, 50_000
#: Stand for the start and the end of a text.
START, END = np.uint64(0x5BD1E995A3B1C7D1), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Tokens:
    """The tokens of some texts, one after another: words and an end each; previous: what stands before (a start or a word)."""

    now: np.ndarray
    previous: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Tokens:
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        whole = np.concatenate([part for x in texts for part in (START, x, END)], axis=None).astype(np.uint64) if texts else np.zeros(0, np.uint64)
        ends = np.cumsum(sizes + 1)
        first = np.zeros(len(whole), bool)
        first[ends - sizes - 1] = True
        last = np.zeros(len(whole), bool)
        last[ends - 1] = True
        return cls(whole[~first], whole[~last], sizes)

    def ngrams(self, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order from 2 on: the tokens that have a history that long (a start counts), and their n-grams' hashes."""
        at, keys = np.arange(len(self.now)), mix(self.previous * A + self.now)
        place = at - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        found = [(at, keys)]
        whole = keys
        for n in range(3, order + 1):
            at = np.flatnonzero(place >= n - 2)
            longer = np.zeros(len(whole), np.uint64)
            longer[at] = mix(whole[at - 1] * A + self.now[at] + np.uint64(n))
            found.append((at, longer[at]))
            whole = longer
        return found


def hashed(text: str | None) -> np.ndarray:
    return word_hashes(lower_words(text or ""))


def by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys, and the end: shards are equal ranges of the hash."""
    starts = np.array([-(-(i << 64) // shards) for i in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def pack(values: np.ndarray) -> bytes:
    """Each value's lower bytes, as many as the largest value has."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    """n values that pack() packed."""
    found = np.zeros((n, 8), np.uint8)
    if n:
        found[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return found.view("<u8").ravel().astype(np.uint64)


def steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences: the more keys of a hash's range, the fewer bytes of each."""
    return np.diff(keys, prepend=np.uint64(0))


class Counted:
    """The distinct keys of a batch with how often its training texts have them."""

    def __init__(self, keys: np.ndarray, train: np.ndarray):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(at, weights=train, minlength=len(self.keys)).astype(np.uint64)


def batch_keys(tokens: Tokens, train: np.ndarray, order: int) -> tuple[Counted, Counted]:
    """Words (with one start for each text) and n-grams of all orders."""
    of_token = np.repeat(train, tokens.sizes)
    words = np.concatenate([mix(tokens.now), np.full(len(train), mix(np.array([START]))[0])])
    grams = tokens.ngrams(order)
    return Counted(words, np.concatenate([of_token, train])), Counted(np.concatenate([keys for _, keys in grams]), np.concatenate([of_token[at] for at, _ in grams]))


REQUEST = "batch bigint, piece bigint, shard int, words binary, word_counts binary, n_words int, ngrams binary, ngram_counts binary, n_ngrams int"
ANSWER = "batch bigint, piece bigint, shard int, word_counts binary, ngram_counts binary, types bigint, tokens bigint"


def requests(batched: DataFrame, shards: int, order: int) -> DataFrame:
    """For each piece of a batch and shard, the distinct keys in it and their counts, packed.

    A piece is a run of a batch's rows that one task has; it is named by the place of its first row. So nothing is
    lost if a batch's rows are read by several tasks.
    """

    def asked(batch: int, piece: int, texts: list[np.ndarray], train: list[bool]) -> pa.RecordBatch:
        columns = [pa.array(np.full(shards, batch)), pa.array(np.full(shards, piece)), pa.array(np.arange(shards, dtype=np.int32))]
        for own in batch_keys(Tokens.of(texts), np.array(train, float), order):
            ends = by_shard(own.keys, shards)
            pairs = list(zip(ends[:-1], ends[1:], strict=True))
            columns += [pa.array([pack(steps(own.keys[i:j])) for i, j in pairs], pa.binary()), pa.array([pack(own.counts[i:j]) for i, j in pairs], pa.binary()), pa.array(np.diff(ends).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in REQUEST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One batch of each kind is open at a time.
        open_now: dict[int, tuple[int, int, list, list]] = {}
        for part in slices(batches):
            for batch, kind, at, out, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if kind not in open_now or open_now[kind][0] != batch:
                    if kind in open_now:
                        yield asked(*open_now[kind])
                    open_now[kind] = batch, at, [], []
                open_now[kind][2].append(hashed(text))
                open_now[kind][3].append(not out)
        for found in open_now.values():
            yield asked(*found)

    return batched.select("batch", "kind", "at", "held_out", "text").mapInArrow(run, REQUEST)


def answers(asked: DataFrame, shards: int, parts: int) -> DataFrame:
    """For each request the counts over all batches, in its keys' order; and a row for each shard (batch null) with its words and tokens.

    A task takes its shards one after another.
    """
    start = mix(np.array([START]))[0]
    names = [x.split()[0] for x in ANSWER.split(", ")]
    fields = pa.schema([(x, pa.binary() if "counts" in x else pa.int32() if x == "shard" else pa.int64()) for x in names])

    def summed(keys: list[bytes], counts: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        whole = np.concatenate([np.cumsum(unpack(x, n), dtype=np.uint64) for x, n in zip(keys, sizes, strict=True)])
        distinct, at = np.unique(whole, return_inverse=True)
        del whole
        sums = np.bincount(at, weights=np.concatenate([unpack(x, n) for x, n in zip(counts, sizes, strict=True)]), minlength=len(distinct)).astype(np.uint64)
        return distinct, sums, np.split(sums[at], np.cumsum(sizes)[:-1])

    def one_shard(shard: int, rows: list[list]) -> Iterator[pa.RecordBatch]:
        ids, pieces, words, word_counts, n_words, grams, gram_counts, n_grams = rows
        distinct, sums, words_out = summed(words, word_counts, n_words)
        grams_out = summed(grams, gram_counts, n_grams)[2]
        known = (sums > 0) & (distinct != start)
        for i in range(0, len(ids), 64):
            own = slice(i, i + 64)
            packed = [pa.array([pack(x) for x in out[own]], pa.binary()) for out in (words_out, grams_out)]
            none = pa.nulls(len(ids[own]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(pieces[own]), pa.array(np.full(len(ids[own]), shard, np.int32)), *packed, none, none], schema=fields)
        one, empty = pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())
        yield pa.RecordBatch.from_arrays([one, one, pa.array([shard], pa.int32()), empty, empty, pa.array([int(known.sum())]), pa.array([int(sums[known].sum())])], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, [[] for _ in range(8)]
        for part in batches:
            for shard, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if shard != now and now is not None:
                    yield from one_shard(now, rows)
                    rows = [[] for _ in range(8)]
                now = shard
                for into, value in zip(rows, row, strict=True):
                    into.append(value)
        if now is not None:
            yield from one_shard(now, rows)

    dealt = asked.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)))
    dealt = dealt.sortWithinPartitions("shard") if shards > parts else dealt
    return dealt.select("shard", "batch", "piece", *[x.split()[0] for x in REQUEST.split(", ")[3:]]).mapInArrow(run, ANSWER)


class BackoffAutomaton:
    """Words and arcs, those of all orders, are sorted by their hashes.

    A state is a history; what a traversal needs of it is how often each of its ends was seen. weights are those of
    orders 2, 3, ... .
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, ngrams: np.ndarray, ngram_counts: np.ndarray, total: int, types: int, weights: tuple[float, ...]):
        self.words, self.counts = words, counts.astype(np.float64)
        self.total, self.types, self.weights = total, types, weights
        self.root = np.log10((self.counts + 1) / (total + types + 1))
        seen = ngram_counts > 0
        self.arcs, self.arc_counts = ngrams[seen], ngram_counts[seen].astype(np.float64)

    @property
    def order(self) -> int:
        return len(self.weights) + 1

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words, mix(hashes))

    def arc_count(self, keys: np.ndarray) -> np.ndarray:
        """How often n-grams were seen; 0 where there is no arc."""
        if not len(self.arcs):
            return np.zeros(len(keys))
        arc = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
        return np.where(self.arcs[arc] == keys, self.arc_counts[arc], 0.0)

    def traverse(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its log10 probability, its sum of word frequencies' log10 and its known tokens.

        All texts advance together, a token at a time, each with its own state. From the root's chance of a word the
        arcs of longer and longer histories follow; without an arc, the chance is that of the shorter history times
        the price of failing.
        """
        n = len(tokens.sizes)
        score, base, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        if not n:
            return score, base, known
        order = np.argsort(-tokens.sizes, kind="stable")
        starts, sizes = (np.cumsum(tokens.sizes) - tokens.sizes)[order], tokens.sizes[order]
        word = self.word(tokens.now)
        arcs = []
        for at, keys in tokens.ngrams(self.order):
            arcs.append(np.zeros(len(word)))
            arcs[-1][at] = self.arc_count(keys)
        # How often the last word, the last two, ... were seen: at first, the start alone.
        state = [np.zeros(n) for _ in self.weights]
        state[0][:] = self.counts[self.word(np.array([START]))[0]]
        running = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        for step, live in enumerate(running):
            at = starts[:live] + step
            now = word[at]
            plain = self.root[now]
            chance = 10.0**plain
            for weight, arc, history in zip(self.weights, arcs, state, strict=True):
                chance = (arc[at] + weight * chance) / (history[:live] + weight)
            score[:live] += np.log10(chance)
            base[:live] += plain
            known[:live] += self.counts[now] > 0
            for longer, arc in zip(state[1:], arcs, strict=False):
                longer[:live] = arc[at]
            state[0][:live] = self.counts[now]
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return score[back], base[back], known[back]


def from_files(docs: DataFrame) -> bool:
    """Whether rows are those of one Parquet table, with columns chosen and rows left out at most: so each has a place in a file."""

    def plain(node) -> bool:
        name = node.nodeName()
        if name.startswith("LogicalRelation"):
            return "parquet" in node.simpleString(10_000).lower()
        return name in ("Project", "Filter", "SubqueryAlias") and plain(node.children().head())

    return plain(docs._jdf.queryExecution().analyzed())


def batches_of(docs: DataFrame) -> DataFrame:
    """The documents with batch, kind (of length) and at, their place in their file: batches are runs of places.

    What a batch is follows from the files alone, whatever task reads them, so it is the same each time. A table
    that isn't read straight from files is written first.
    """
    docs = docs.select("doc_id", "held_out", "text")
    docs = docs if from_files(docs) else stash(docs, "lm-documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    kind: Column = F.lit(KINDS - 1)
    for i in reversed(range(KINDS - 1)):
        kind = F.when(size <= SHORT * 4**i, i).otherwise(kind)
    rows = F.element_at(F.array(*[F.lit(max(1, ROWS // 4**i)) for i in range(KINDS)]), kind + 1)
    at = F.col("_metadata.row_index")
    batch = F.xxhash64("_metadata.file_path", kind, F.floor(at / rows))
    return docs.select("doc_id", "held_out", "text", batch.alias("batch"), kind.alias("kind"), at.alias("at"))


def input_bytes(df: DataFrame) -> int:
    """About how much df reads, as its plan knows: it sets numbers of parts, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def score_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text, held_out).

    weights: one for bigrams, another for trigrams, and so on. Texts that are held out are scored, not learned from.
    A null text is empty: its end alone is scored. Ids may be null or repeat; a null held_out counts as false. Other
    columns are left out. Without training texts every token costs what the root asks. docs, whatever its plan, is
    read twice, or written first where it isn't a table of files; an empty table gives no rows.
    """
    spark = small_batches(docs).sparkSession
    width, order = shuffle_width(spark), len(weights) + 1
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    batched = batches_of(docs)
    shards = shards or max(width, -(-input_bytes(batched) // SHARD_BYTES))
    parts = min(shards, max(width, PARTS))
    answered = stash(answers(requests(batched, shards, order), shards, parts), "lm-counts", compression="zstd")
    sums = answered.where("batch is null").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).first()
    types, total = int(sums["types"] or 0), int(sums["tokens"] or 0)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        texts = texts.sort_by("at")
        hashes = [hashed(x) for part in slices(iter(texts.select(["text"]).to_batches())) for x in part.column(0).to_pylist()]
        train = 1.0 - texts.column("held_out").to_numpy().astype(float)
        of_piece = counts.column("piece").to_numpy()
        firsts = np.unique(of_piece)
        ends = np.append(np.searchsorted(texts.column("at").to_numpy(), firsts), len(hashes))
        shard, done = counts.column("shard").to_numpy(), []
        for i, j, first in zip(ends[:-1], ends[1:], firsts, strict=True):
            tokens = Tokens.of(hashes[i:j])
            own = np.flatnonzero(of_piece == first)
            own = own[np.argsort(shard[own])]
            full = []
            for found, name in zip(batch_keys(tokens, train[i:j], order), ("word_counts", "ngram_counts"), strict=True):
                packed = counts.column(name).take(pa.array(own)).to_pylist()
                full += [found.keys, np.concatenate([unpack(x, n) for x, n in zip(packed, np.diff(by_shard(found.keys, shards)), strict=True)])]
            done.append((tokens.sizes, *BackoffAutomaton(*full, total, types, weights).traverse(tokens)))
        sizes, score, base, known = (np.concatenate(x) for x in zip(*done, strict=True))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": sizes, "n_known": known, "base_score": base, "score": score})

    asked = answered.where("batch is not null").select("batch", "piece", "shard", "word_counts", "ngram_counts")
    texts = batched.select("doc_id", "held_out", "text", "batch", "at")
    if parts > width:  # more of both than the session's partitions are meant for
        texts, asked = texts.repartition(parts, "batch"), asked.repartition(parts, "batch")
    joined = texts.groupBy("batch").cogroup(asked.groupBy("batch"))
    scored = joined.applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs.withColumn("held_out", held_out(F.col("doc_id"), 7)))
