"""Quality of documents by a linear-chain conditional random field over their lines.

Every line gets features of its own and of its neighbours; the field labels each line good or bad, and the
forward-backward marginals of the lines, weighted by length, make the document's quality. The field learns from a
bounded sample of labelled documents, whose lines take the label of their document; a logistic curve turns the
weighted marginal into the chance of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import held_out, slices, small_batches, stash, table
from lattica.llm.words import A, mix

#: Labelled documents of each label that the field learns from at most, and characters of all of them.
SAMPLE, SAMPLE_CHARS = 2000, 24_000_000
#: From this score on, a document is predicted to be good.
THRESHOLD = 0.7

#: Classes of bytes: other, space, upper case, lower case, digit, beyond ASCII, sentence mark, exclamation mark, bar, symbol.
KINDS = np.zeros(256, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 1
KINDS[65:91] = 2
KINDS[97:123] = 3
KINDS[48:58] = 4
KINDS[128:] = 5
KINDS[list(b".,;:?'\"()-")] = 6
KINDS[ord("!")] = 7
KINDS[ord("|")] = 8
KINDS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = 9
#: Fixed random weights of bytes and of their places in a word, for word hashes.
BYTE_WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64) * A)
PLACE_WEIGHTS = mix(np.arange(1001, 1065, dtype=np.uint64) * A) | np.uint64(1)

FEATURES = ("words", "upper", "lower", "digit", "beyond", "mark", "exclamation", "bar", "symbol", "word_length", "ends", "repeated", "doubled", "distinct")


@dataclass
class Lines:
    """Features of the lines of some texts that are not blank; length in bytes; text: number of each line's text, ascending."""

    x: np.ndarray
    length: np.ndarray
    text: np.ndarray


def share(values: np.ndarray, groups: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n) / np.maximum(of, 1)


def line_features(texts: list[bytes]) -> Lines:
    """All features are shares, means or logarithms, so lines of any length compare."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    newline = data == 10
    starts = np.concatenate([[0], np.flatnonzero(newline)[:-1] + 1])
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    text = np.searchsorted(firsts, starts, side="right") - 1
    kind = KINDS[data]
    size = np.diff(np.append(starts, len(data))) - 1
    n = len(starts)
    counts = np.stack([np.add.reduceat(kind == k, starts, dtype=np.int32) for k in range(10)], 1).astype(float)
    solid = kind != 1
    begins = solid & np.append(True, ~solid[:-1])
    at = np.flatnonzero(begins)
    x = np.zeros((n, len(FEATURES)))
    if len(at):
        word = np.cumsum(begins) - 1
        place = (np.arange(len(data)) - at[np.maximum(word, 0)]) & 63
        hashes = np.add.reduceat(np.where(solid, BYTE_WEIGHTS[data] * PLACE_WEIGHTS[place], np.uint64(0)), at)
        line = np.searchsorted(starts, at, side="right") - 1
        own = text[line]
        words = np.bincount(line, minlength=n)
        three = mix((hashes[:-2] * A + hashes[1:-1]) * A + hashes[2:] + own[:-2].astype(np.uint64) * PLACE_WEIGHTS[0]) if len(at) > 2 else np.zeros(0, np.uint64)
        within = own[:-2] == own[2:] if len(at) > 2 else np.zeros(0, bool)
        _, which, times = np.unique(three[within], return_inverse=True, return_counts=True)
        repeated = np.zeros(len(at))
        repeated[np.flatnonzero(within)] = times[which] > 1
        doubled = np.zeros(len(at))
        doubled[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((hashes, line))
        fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))
        last = data[np.maximum(starts + size - 1, 0)]
        body = np.maximum(counts[:, 2:].sum(1), 1)
        x[:, 0] = np.log1p(words)
        x[:, 1:9] = counts[:, 2:10] / body[:, None]
        x[:, 9] = np.log1p(body / np.maximum(words, 1))
        x[:, 10] = np.isin(last, list(b".!?:"))
        x[:, 11] = share(repeated, line, n, words)
        x[:, 12] = share(doubled, line, n, words)
        x[:, 13] = share(fresh.astype(float), line[order], n, words)
        full = words > 0
    else:
        full = np.zeros(n, bool)
    return Lines(x[full], size[full], text[full])


def features_of(texts: list[bytes], size: int = 128) -> Lines:
    """The same for many texts, a few at a time: arrays of single bytes stay small."""
    parts = [line_features(texts[i : i + size]) for i in range(0, len(texts), size)]
    numbers = [part.text + i * size for i, part in enumerate(parts)]
    return Lines(np.concatenate([part.x for part in parts]), np.concatenate([part.length for part in parts]), np.concatenate(numbers))


def with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's features, a constant, and the features of the line before and after in its text (zeros where there is none)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (text[1:] == text[:-1])[:, None]
    before[1:] = np.where(same, x[:-1], 0)
    after[:-1] = np.where(same, x[1:], 0)
    return np.hstack([x, np.ones((len(x), 1)), before, after])


class Chains:
    """Lines of many texts, walked in step: texts with more lines stay longer."""

    def __init__(self, text: np.ndarray):
        first = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, len(text)))
        order = np.argsort(-sizes, kind="stable")
        self.starts, self.sizes = starts[order], sizes[order]
        self.live = np.searchsorted(-self.sizes, -np.arange(1, (self.sizes[0] if len(sizes) else 0) + 1), side="right")

    def odds(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good against bad: by a line and those before it, and by those after it. e: a line's own; t[y, y']: a step's score."""
        ahead, back = np.zeros(len(e)), np.zeros(len(e))
        for step, live in enumerate(self.live):
            at = self.starts[:live] + step
            if step:
                a = ahead[at - 1]
                ahead[at] = e[at] + np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])
            else:
                ahead[at] = e[at]
        for step in range(len(self.live) - 1, 0, -1):
            at = self.starts[: self.live[step]] + step
            b = e[at] + back[at]
            back[at - 1] = np.logaddexp(t[1, 1] + b, t[1, 0]) - np.logaddexp(t[0, 1] + b, t[0, 0])
        return ahead, back


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class QualityField:
    """The trained field; base alone is used where there was nothing to learn from, and for texts without lines."""

    base: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None
    curve: tuple[float, float] = (1.0, 0.0)

    def emissions(self, lines: Lines) -> np.ndarray:
        return with_neighbours((lines.x - self.mean) / self.scale, lines.text) @ self.weights

    def line_marginals(self, lines: Lines) -> np.ndarray:
        """The chance that each line is good."""
        ahead, back = Chains(lines.text).odds(self.emissions(lines), self.steps)
        return sigmoid(ahead + back)

    def raw(self, lines: Lines, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted marginals of n texts, and their lengths."""
        total = np.bincount(lines.text, weights=lines.length, minlength=n)
        return np.bincount(lines.text, weights=lines.length * self.line_marginals(lines), minlength=n) / np.maximum(total, 1), total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.base)
        raw, total = self.raw(line_features(texts), len(texts))
        a, b = self.curve
        return np.where(total > 0, sigmoid(a * logit(raw) + b), self.base)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def adam(start: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return x


def train(texts: list[bytes], labels: np.ndarray, base: float, rounds: int = 150, penalty: float = 1e-3) -> QualityField:
    """Conditional likelihood of the lines' labels, each text counting once and each label by half; then the curve, at the base rate."""
    if len(set(labels.tolist())) < 2:
        return QualityField(base)
    lines = features_of(texts)
    if not len(lines.x):
        return QualityField(base)
    field = QualityField(base, lines.x.mean(0), lines.x.std(0) + 1e-6)
    x = with_neighbours((lines.x - field.mean) / field.scale, lines.text)
    good = labels[lines.text].astype(float)
    halves = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    per_line = (halves / np.maximum(np.bincount(lines.text, minlength=len(texts)), 1))[lines.text]
    chains, inner = Chains(lines.text), np.flatnonzero(lines.text[1:] == lines.text[:-1])
    d = x.shape[1]

    def gradient(p: np.ndarray) -> np.ndarray:
        e, t = x @ p[:d], p[d:].reshape(2, 2)
        ahead, back = chains.odds(e, t)
        g = np.empty_like(p)
        g[:d] = x.T @ (per_line * (sigmoid(ahead + back) - good))
        a, b = ahead[inner], e[inner + 1] + back[inner + 1]
        both = np.stack([np.full(len(a), t[0, 0]), t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b])
        both = np.exp(both - both.max(0))
        both /= both.sum(0)
        seen = (2 * good[inner] + good[inner + 1]).astype(int)
        g[d:] = (both * per_line[inner]).sum(1) - np.bincount(seen, weights=per_line[inner], minlength=4)
        return g + penalty * p

    p = adam(np.zeros(d + 4), gradient, rounds, 0.1)
    field.weights, field.steps = p[:d], p[d:].reshape(2, 2)
    raw, total = field.raw(lines, len(texts))
    z, y = logit(raw[total > 0]), labels[total > 0].astype(float)
    weight = np.where(y == 1, base / max(1, y.sum()), (1 - base) / max(1, (1 - y).sum()))

    def slope(c: np.ndarray) -> np.ndarray:
        off = weight * (sigmoid(c[0] * z + c[1]) - y)
        return np.array([(off * z).sum(), off.sum()]) + 1e-4 * c

    field.curve = tuple(adam(np.array([1.0, 0.0]), slope, 400, 0.05).tolist())
    return field


def within(picked: list[list], chars: int) -> list:
    """Rows of each list, in its order, that fit its equal share of the characters; then skipped ones that fit what is left of all.

    A row that doesn't fit is skipped, not the rows after it. Skipped ones get their turn by place, over all lists.
    """
    chosen, skipped, spare = [], [], chars
    for part in picked:
        left = chars // len(picked)
        for place, row in enumerate(part):
            if row["chars"] <= left:
                left -= row["chars"]
                spare -= row["chars"]
                chosen.append(row)
            else:
                skipped.append((place, row))
    for _, row in sorted(skipped, key=lambda x: x[0]):
        if row["chars"] <= spare:
            spare -= row["chars"]
            chosen.append(row)
    return chosen


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> QualityField:
    """Trains on at most `sample` documents of each label, those of the smallest hashed ids, and at most `chars` characters.

    The characters are shared as in within(): half for each label, in the order of hashed ids, long or short; what
    one label leaves goes to the other.
    labels: doc_id, quality (0 or 1; other values and nulls are left out; a document with both labels counts as 0).
    Only sizes and ids are sorted; whole texts of the chosen documents alone reach the driver.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).alias("chars"))
    known = stash(sizes.join(marks, "doc_id").where("chars > 0"), "labelled")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    n = sum(counts.values())
    if not n:
        return QualityField(0.5)
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect() for q in (0, 1)]
    chosen = [(r["doc_id"], r["quality"]) for r in within(picked, chars)]
    spark = docs.sparkSession
    # At most twice the sample: small enough to broadcast.
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id bigint, quality int")) if chosen else None
    if ids is None:
        return QualityField(counts.get(1, 0) / n)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").join(ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))
    found = rows.orderBy("doc_id").toArrow()
    texts = [x.encode() for x in found.column("text").to_pylist()]
    return train(texts, np.array(found.column("quality").to_pylist(), int), counts.get(1, 0) / n)


def score(docs: DataFrame, field: QualityField, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on); columns of these names are replaced.

    Texts that are null or blank get the base rate of label 1. Every row is answered by itself, whatever its id.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = field.scores([(x or "").encode() for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    schema = docs.select(*rest).schema.add("score", "double").add("predicted", "integer")
    return small_batches(docs).select(*rest).mapInArrow(run, schema)


def learn_and_score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learns from the labelled rows that aren't held out (crc32 of the id modulo 4 is not 2), and scores every row."""
    field = learn(docs.where(~held_out(F.col("doc_id"), 4)), labels)
    return score(docs, field, threshold)


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = learn_and_score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")
