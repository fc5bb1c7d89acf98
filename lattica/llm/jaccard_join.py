"""Similarity join of texts by the Jaccard similarity of their word shingles, by signature trees.

1. Routing. Two sets of sizes s and s' that reach the threshold t differ in at most D = (s + s') (1 - t) / (1 + t)
   shingles. Sets are cut into P > D segments by ranges of the hash; at least P - D segments are then the same in
   both. Every document leaves out its P - D - 1 weakest segments and announces the rest: the strongest segment
   that two linked documents share is announced by both, so no link is lost, whatever is called strong, as long as
   it follows from a segment's content. A segment is as strong as its rarest shingle is rare, by a table of counts
   over all documents that has a fixed size: passages that many documents share don't bring those together.
   D depends on the size, so sizes fall into bands, and a document announces to its own band and the next.
   Documents that share an announcement fall into one candidate group.
2. Join. Groups are dealt to shards of some million shingles, distinct sets only (a group larger than a shard is cut
   into blocks by size and hash, and each pair of blocks that may link is a task). A shard's sets become the leaves
   of one signature tree, whose nodes hold the OR of their documents' token bitmaps and their range of sizes. Its
   dual traversal alone finds the pairs of leaves that can link, whatever their groups: it drops pairs of nodes
   whose sizes or largest possible overlap don't reach the threshold. Exact overlaps settle the pairs that remain.
3. Links of sets become components. Copies of a set never travel: a class has one representative.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import shuffle_width, slices, small_batches, stash, table
from lattica.llm.graph import FEW, SHARE, components
from lattica.llm.words import mix, shingle_set

#: Documents whose announcements are combined before they are shuffled.
CHUNK = 4096
#: Cells of the table of counts (a power of two), pieces that it is summed up in, and segments beyond D + 1, as a share of them.
CELLS, PIECES, SPARE = 1 << 20, 64, 0.6
#: Shingles of a shard or block; larger groups are cut.
BLOCK = 1_000_000
#: Documents and shingles of a leaf, children of a node.
LEAF, LEAF_SHINGLES, FAN_OUT = 16, 32_768, 4
#: Bits of a bitmap at most, bytes of a level's bitmaps, and of those that are compared at a time.
MOST_BITS, LEVEL_BYTES, STEP_BYTES = 1 << 22, 32 << 20, 16 << 20
#: Rows that may be broadcast to find the texts of candidate groups; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


class Bands:
    """Bands of sizes for a threshold in hundredths: linked sets are in the same or in neighbouring bands."""

    def __init__(self, percent: int):
        self.t, starts = percent, [1]
        while starts[-1] < 1 << 31:
            starts.append(starts[-1] * 100 // percent + 1 if percent < 100 else 2 * starts[-1])
        self.starts = np.array(starts, np.int64)

    def of(self, size):
        return np.searchsorted(self.starts, size, side="right") - 1

    def differences(self, band: int) -> int:
        """The most shingles that are in one set only, if the larger is in this band."""
        return int(2 * (self.starts[band + 1] - 1) * (100 - self.t) // (100 + self.t))

    def links(self, overlap, a, b):
        return 100 * overlap >= self.t * (a + b - overlap)


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles + np.uint64(0x1234567)) & np.uint64(CELLS - 1)).astype(np.int64)


def shingle_counts(docs: DataFrame, n: int, parts: int) -> np.ndarray:
    """How many shingles of all documents fall into each cell: 4 MB, however many documents there are."""
    size = CELLS // PIECES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in slices(batches):
            found = [shingle_set(text, n) for text in batch.column(0).to_pylist()]
            counts += np.bincount(cell_of(np.concatenate(found)), minlength=CELLS)
        counts = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([counts[i * size : (i + 1) * size].tobytes() for i in range(PIECES)], pa.binary())], names=["piece", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(counts, np.uint32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["piece", "counts"])

    schema = "piece int, counts binary"
    pieces = docs.select(F.col("text").cast("string")).mapInArrow(counted, schema)
    rows = pieces.repartitionById(min(parts, PIECES), F.col("piece")).mapInArrow(summed, schema).collect()
    table = np.zeros(CELLS, np.float32)
    for row in rows:
        table[row["piece"] * size : (row["piece"] + 1) * size] = np.frombuffer(row["counts"], np.float32)
    return table


def announcements(shingles: np.ndarray, bands: Bands, cuts: dict[int, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Hashes of the segments that a set announces, to its band and the next.

    A segment with a shingle that no other document has meets nothing and is not announced.
    """
    size = len(shingles)
    own = int(bands.of(size))
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
    rarity = counts[cell_of(shingles)]
    out = []
    for band in (own, own + 1):
        if band > own and size * 100 // bands.t < bands.starts[band]:
            continue
        most = bands.differences(band)
        if not most:  # alike sets only: the whole set's hash is announced anyway
            continue
        n = most + 1 + int((most + 1) * SPARE)
        if n not in cuts:
            cuts[n] = np.array([(i << 64) // n for i in range(n)], np.uint64)
        ends = np.append(np.searchsorted(shingles, cuts[n]), size)
        segment = mix((mixed[ends[1:]] - mixed[ends[:-1]]) ^ mix(np.arange(n, dtype=np.uint64) + np.uint64(band << 32)))
        full = np.flatnonzero(ends[1:] > ends[:-1])
        common = np.full(n, np.inf)
        common[full] = np.minimum.reduceat(rarity, ends[:-1][full])
        kept = np.lexsort((segment, common))[: most + 1]
        out.append(segment[kept[common[kept] > 1]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(mix(shingles ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (0x1357, 0x2468ACE))


def announce(docs: DataFrame, n: int, percent: int, parts: int, counts: Broadcast) -> DataFrame:
    """Packed rows: part and arrays of announcements and their sets, or (part null) one document's doc_id, size and set hash.

    A set is named by the first half of its hash, so copies announce as one.
    """
    fields = pa.schema([("part", pa.int32()), ("seals", pa.binary()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("size", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def combined(seals: list[np.ndarray], ids: list[int]) -> pa.RecordBatch | None:
        """One row for each part. An announcement is sent once, with its smallest set; the others announce a private pair with that one."""
        sizes = [len(x) for x in seals]
        seal, doc = np.concatenate(seals), np.repeat(np.array(ids, np.int64), sizes)
        order = np.lexsort((doc, seal))
        seal, doc = seal[order], doc[order]
        if not len(seal):
            return None
        first = np.append(True, seal[1:] != seal[:-1])
        least = doc[first][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([least, doc], 1)[doc != least], axis=0)
        if len(pairs):
            a, b = pairs.view(np.uint64).T
            private = mix(mix(a) + mix(b ^ np.uint64(0x5555)))
            seal, doc = np.concatenate([seal[first], private, private]), np.concatenate([doc[first], pairs[:, 0], pairs[:, 1]])
        else:
            seal, doc = seal[first], doc[first]
        part = (seal % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, seal, doc = part[order], seal[order], doc[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(starts[1:], len(part))
        none = pa.nulls(len(starts), pa.int64())
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in (seal, doc)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), *packed, none, none, none, none], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, cuts, seals, ids, held = Bands(percent), {}, [], [], 0
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = shingle_set(text, n)
                h1, h2 = set_hash(shingles)
                rows.append((doc, len(shingles), h1, h2))
                if doc is not None and len(shingles):
                    seals.append(announcements(shingles, bands, cuts, counts.value))
                    ids.append(h1)
                    held += len(seals[-1])
            none = pa.nulls(len(rows), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), none, none, *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], schema=fields)
            if len(ids) >= CHUNK or held >= CHUNK * 256:
                if (found := combined(seals, ids)) is not None:
                    yield found
                seals, ids, held = [], [], 0
        if ids and (found := combined(seals, ids)) is not None:
            yield found

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "part int, seals binary, ids binary, doc_id bigint, size bigint, h1 bigint, h2 bigint")


def meetings(announced: DataFrame, parts: int) -> DataFrame:
    """a, b: each set that shares an announcement, with the smallest that shares it; each pair once.

    A pair that shares many announcements is found in many tasks. They send their pairs packed, by document, so that
    one more task each can drop the repetitions.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seals, ids = [], []
        for batch in batches:
            seals += [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
            ids += [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        if not seals:
            return
        seal, doc = np.concatenate(seals), np.concatenate(ids)
        del seals, ids
        order = np.lexsort((doc, seal))
        seal, doc = seal[order], doc[order]
        first = np.append(True, seal[1:] != seal[:-1])
        least = doc[first][np.cumsum(first) - 1]
        pairs = np.unique(np.stack([doc, least], 1)[doc != least], axis=0)
        part = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, pairs = part[order], pairs[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, int)
        packed = [x.tobytes() for x in np.split(pairs, starts[1:])] if len(part) else []
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(packed, pa.binary())], names=["part", "pairs"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((0, 2), np.int64)
        for batch in batches:
            fresh = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column(0).to_pylist()]
            found = np.unique(np.concatenate([found, *fresh]), axis=0)
        for i in range(0, len(found), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(found[i : i + 65536, c]) for c in (0, 1)], names=["a", "b"])

    rows = announced.where("part is not null").repartitionById(parts, F.col("part")).select("seals", "ids")
    packed = rows.mapInArrow(met, "part int, pairs binary").repartitionById(parts, F.col("part"))
    return packed.select("pairs").mapInArrow(once, "a bigint, b bigint")


class SignatureTree:
    """Levels of nodes over sets, leaves first: OR of bitmaps, smallest and largest size, and most shingles lost to shared bits.

    near orders the sets, those that may link next to each other: leaves are runs of it. The bitmaps of a level are
    as wide as unions of its nodes need, so that nodes of unrelated sets share fewer bits than a link would; both
    trees of a join have the same widths.
    """

    def __init__(self, sets: list[np.ndarray], near: np.ndarray):
        self.sets = sets
        sizes = np.array([len(x) for x in sets], np.int64)
        self.sizes = sizes
        self.leaves: list[np.ndarray] = []
        held, total = [], 0
        for i in near.tolist():
            if held and (len(held) == LEAF or total + sizes[i] > LEAF_SHINGLES):
                self.leaves.append(np.array(held))
                held, total = [], 0
            held.append(i)
            total += sizes[i]
        self.leaves.append(np.array(held))
        self.members = [self.leaves]
        while len(self.members[-1]) > 1:
            below = self.members[-1]
            self.members.append([np.concatenate(below[i : i + FAN_OUT]) for i in range(0, len(below), FAN_OUT)])
        self.levels: list[tuple] = []

    def widths(self, percent: int) -> list[int]:
        """Bits that each level needs: unions of u shingles share about u * u / bits of them by chance."""
        needed = max(1, int(np.median(self.sizes)) * 2 * percent // (100 + percent))
        found = []
        for nodes in self.members:
            most = max(len(np.unique(np.concatenate([self.sets[i] for i in own]))) for own in nodes)
            bits = 1 << (max(8 * most, 3 * most * most // needed, 1024) - 1).bit_length()
            room = 1 << (8 * LEVEL_BYTES // len(nodes)).bit_length() - 1
            found.append(max(1024, min(bits, room, MOST_BITS)))
        return found

    def fill(self, widths: list[int]) -> None:
        """Makes the bitmaps."""
        for nodes, bits in zip(self.members, widths, strict=False):
            maps = np.zeros((len(nodes), bits // 8), np.uint8)
            lost = np.zeros(len(nodes), np.int64)
            for node, own in enumerate(nodes):
                dense = np.zeros(bits, bool)
                for i in own:
                    at = np.unique(self.sets[i] & np.uint64(bits - 1))
                    lost[node] = max(lost[node], self.sizes[i] - len(at))
                    dense[at] = True
                maps[node] = np.packbits(dense)
            low, high = (np.array([f(self.sizes[own]) for own in nodes]) for f in (np.min, np.max))
            self.levels.append((maps.view(np.uint64), low, high, lost))


def node_pairs(left: SignatureTree, right: SignatureTree, bands: Bands, alike: bool) -> np.ndarray:
    """Pairs of leaves that the dual traversal can't drop, a row each. alike: one tree against itself, each pair once."""
    # The lower tree waits at its root until the other has come down to its height: widths agree on common levels alone.
    up, down = len(left.levels) - 1, len(right.levels) - 1
    pairs = np.zeros((1, 2), np.int64)
    while True:
        (bits_a, low_a, high_a, lost_a), (bits_b, low_b, high_b, lost_b) = left.levels[up], right.levels[down]
        a, b = pairs.T
        fits = bands.t * np.maximum(low_a[a], low_b[b]) <= 100 * np.minimum(high_a[a], high_b[b])
        a, b = a[fits], b[fits]
        if up == down:
            kept, step = [], max(1, STEP_BYTES // (8 * bits_a.shape[1]))
            for i in range(0, len(a), step):
                c, d = a[i : i + step], b[i : i + step]
                shared = np.bitwise_count(bits_a[c] & bits_b[d]).sum(1, dtype=np.int64) + np.minimum(lost_a[c], lost_b[d])
                most = np.minimum(shared, np.minimum(high_a[c], high_b[d]))
                kept.append((100 + bands.t) * most >= bands.t * (low_a[c] + low_b[d]))
            fits = np.concatenate(kept) if kept else np.zeros(0, bool)
            a, b = a[fits], b[fits]
        pairs = np.stack([a, b], 1)
        if up == down == 0:
            return pairs
        step_a, step_b = up >= down, down >= up
        below = []
        for i in range(0, len(pairs), 65536):
            a, b = pairs[i : i + 65536].T
            for x in range(FAN_OUT if step_a else 1):
                for y in range(FAN_OUT if step_b else 1):
                    c, d = (a * FAN_OUT + x if step_a else a), (b * FAN_OUT + y if step_b else b)
                    real = (c < len(left.levels[up - step_a][1])) & (d < len(right.levels[down - step_b][1]))
                    if alike:
                        real &= c <= d
                    below.append(np.stack([c[real], d[real]], 1))
        pairs = np.concatenate(below) if below else np.zeros((0, 2), np.int64)
        up, down = up - step_a, down - step_b


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of the intersections of all of a with all of b."""
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    table = np.zeros((len(a) + len(b), len(values)), np.float32)
    table[rows, at] = 1
    return np.rint(table[: len(a)] @ table[len(a) :].T).astype(np.int64)


def in_order(sets: list[np.ndarray], groups: list[int] | None = None) -> np.ndarray:
    """Sets of one group next to each other, groups by their smallest set, sets by their smallest hash."""
    sizes = np.array([len(x) for x in sets], np.int64)
    first = np.array([x[0] for x in sets], np.uint64)
    if groups is None:
        return np.lexsort((first, sizes))
    _, at = np.unique(np.array(groups, np.int64), return_inverse=True)
    least = np.full(at.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, at, sizes)
    return np.lexsort((first, at, least[at]))


def tree_join(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, bands: Bands, groups: list[int] | None = None, tally: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked sets, batch by batch; within sets_a, each pair once, if sets_b is None.

    groups say which of sets_a may stand together in a leaf; they drop nothing. tally counts pairs of leaves, and
    those of them that the trees leave.
    """
    left = SignatureTree(sets_a, in_order(sets_a, groups))
    right = left if sets_b is None else SignatureTree(sets_b, in_order(sets_b))
    widths = left.widths(bands.t)
    if sets_b is not None:
        widths = [max(x) for x in itertools.zip_longest(widths, right.widths(bands.t), fillvalue=0)]
        right.fill(widths)
    left.fill(widths)
    kept = node_pairs(left, right, bands, sets_b is None)
    if tally is not None:
        n, m = len(left.leaves), len(right.leaves)
        tally["pairs"] = tally.get("pairs", 0) + (n * (n + 1) // 2 if sets_b is None else n * m)
        tally["kept"] = tally.get("kept", 0) + len(kept)
    for i, j in kept.tolist():
        a, b = left.leaves[i], right.leaves[j]
        shared = overlaps([left.sets[x] for x in a], [right.sets[x] for x in b])
        linked = bands.links(shared, left.sizes[a][:, None], right.sizes[b][None, :])
        if sets_b is None and i == j:
            linked &= np.triu(np.ones_like(linked), 1).astype(bool)
        x, y = np.nonzero(linked)
        yield a[x], b[y]


class Forest:
    """Union-find over positions: union() says whether it joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def join_groups(rows: DataFrame, n: int, percent: int, width: int, all_pairs: bool = False) -> DataFrame:
    """a, b, links: links between sets that hold a task's links together (b set), and how many texts a links with (b null).

    rows: task, side (0: the task's sets join each other; 1 and 2: those of one side join the other's), near, h1, h2,
    copies, text. A set is named by h1; rows whose text has another set are left out. With all_pairs, every link
    between sets is a row.
    """
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def one_task(found: dict[tuple, tuple]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        crossed = next(iter(found))[0] > 0
        sides = [[(*key[1:2], *x) for key, x in found.items() if key[0] == side] for side in ((1, 2) if crossed else (0,))]
        if len(found) < 2 or not all(sides):
            return
        names = np.array([x[0] for own in sides for x in own], np.int64)
        copies = np.array([x[2] for own in sides for x in own], np.int64)
        sets = [[x[3] for x in own] for own in sides]
        links, forest, edges = np.zeros(len(names), np.int64), Forest(len(names)), []
        for x, y in tree_join(sets[0], sets[1] if crossed else None, bands, None if crossed else [x[1] for x in sides[0]]):
            y = y + len(sides[0]) if crossed else y
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            edges += [(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if all_pairs or forest.union(i, j)]
            if len(edges) > 65536:
                i, j = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), pa.nulls(len(i), pa.int64())], schema=fields)
                edges = []
        if edges:
            i, j = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), pa.nulls(len(i), pa.int64())], schema=fields)
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.nulls(len(at), pa.int64()), pa.array(links[at])], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, found = None, {}
        for batch in slices(batches):
            for key, side, near, h1, h2, copies, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != task and found:
                    yield from one_task(found)
                    found = {}
                task = key
                if (side, h1, h2) not in found and set_hash(shingles := shingle_set(text, n)) == (h1, h2):
                    found[side, h1, h2] = near, copies, shingles
        if found:
            yield from one_task(found)

    dealt = rows.select("task", "side", "near", "h1", "h2", "copies", "text").repartition(width, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "a bigint, b bigint, links bigint")


def deal_tasks(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """task, side, near and the set for each set (h1, h2, rep, copies, size, component): once in most cases, on side 0.

    Groups are dealt by hash to as many shards as their shingles fill; a shard is a task. A group of more than block
    shingles is cut into blocks by band of size and hash; a task then is a pair of blocks of the same or of
    neighbouring bands, and a block goes to each of its pairs.
    """
    starts = Bands(percent).starts.tolist()
    banded = sets.withColumn("band", F.array_size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda x: x <= F.col("size"))))
    sums = banded.groupBy("component", "band").agg(F.sum("size").alias("in_band"), F.count(F.lit(1)).alias("n"))
    group = W.partitionBy("component")
    sums = sums.withColumn("total", F.sum("in_band").over(group)).withColumn("members", F.sum("n").over(group)).where("members > 1")
    cut = F.when(F.col("total") > block, F.ceil(F.col("in_band") / block).cast("int")).otherwise(0)
    sums = sums.select("component", "band", "in_band", cut.alias("blocks"))
    near = group.orderBy("band")
    for name, f, gap in (("before", F.lag, -1), ("after", F.lead, 1)):
        sums = sums.withColumn(name, F.when(f("band").over(near) == F.col("band") + gap, f("blocks").over(near)).otherwise(0))
    sums = stash(sums, "groups")
    whole = sums.where("blocks = 0").agg(F.sum("in_band")).first()[0] or 0
    rows = banded.join(sums, ["component", "band"])
    own = F.pmod(F.xxhash64("h1", "h2"), F.greatest("blocks", F.lit(1))).cast("int")

    def task(band, i, next_band, j):
        return F.concat_ws("/", F.col("component").cast("string"), *(x.cast("string") for x in (band, i, next_band, j)))

    band = F.col("band")

    def each(n, f):
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda j: j < n), f)

    same = each(F.col("blocks"), lambda j: F.struct(task(band, F.least(own, j), band, F.greatest(own, j)).alias("task"), F.when(own == j, 0).when(own < j, 1).otherwise(2).alias("side")))
    up = each(F.col("after"), lambda j: F.struct(task(band, own, band + 1, j).alias("task"), F.lit(1).alias("side")))
    down = each(F.col("before"), lambda j: F.struct(task(band - 1, j, band, own).alias("task"), F.lit(2).alias("side")))
    shard = F.pmod(F.xxhash64("component"), F.lit(whole // block + 1)).cast("string")
    tasks = F.when(F.col("blocks") == 0, F.array(F.struct(shard.alias("task"), F.lit(0).alias("side")))).otherwise(F.concat(same, up, down))
    return rows.select("h1", "h2", "rep", "copies", F.col("component").alias("near"), F.explode(tasks).alias("to")).select("to.task", "to.side", "near", "h1", "h2", "rep", "copies")


def task_rows(docs: DataFrame, classes: DataFrame, announced: DataFrame, percent: int, block: int) -> DataFrame:
    """The rows of join_groups: sets that share announcements, each with the text of its representative."""
    groups = components(meetings(announced, shuffle_width(docs.sparkSession)))
    sets = classes.join(groups, F.col("h1") == F.col("node")).select("h1", "h2", "rep", "copies", "size", "component")
    dealt = stash(deal_tasks(sets, percent, block), "tasks")
    wanted = dealt if dealt.count() > BROADCAST_ROWS else F.broadcast(dealt)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(wanted, F.col("id") == F.col("rep")).drop("id", "rep")


def similarity_join(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK, all_pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (doc_id, n_shingles, h1, h2), classes (h1, h2, rep, copies, size) and links (a, b, links) between classes by h1.

    links has a row with b for links that hold all linked classes together (with all_pairs: for every link), and
    rows without b whose sum over links is the number of documents of other classes that a links with.
    """
    spark = small_batches(docs).sparkSession
    width = shuffle_width(spark)
    counts = spark.sparkContext.broadcast(shingle_counts(docs, n, width))  # 4 MB
    announced = stash(announce(docs, n, percent, width, counts), "announced")
    sized = announced.where("part is null").select("doc_id", F.col("size").alias("n_shingles"), "h1", "h2")
    classes = sized.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"))
    return sized, classes, stash(join_groups(task_rows(docs, classes, announced, percent, block), n, percent, width, all_pairs), "links")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of documents (doc_id, text; other columns are left out).

    Documents link when 100 * |intersection| >= percent * |union| of their sets of n-word shingles. component_id is
    the smallest doc_id that links reach. n_links counts the other documents that it links with, copies included.
    Null or wordless texts have no shingles and link with nothing. Rows without a doc_id get no component and no
    links. Rows that share a doc_id are documents of their own that happen to have one name. An empty table gives
    no rows.
    """
    sized, classes, links = similarity_join(docs, n, percent, block)
    joined = components(links.where("b is not null").select("a", "b"))
    counted = links.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    known = classes.join(joined, F.col("h1") == F.col("node"), "left").join(counted, F.col("h1") == F.col("a"), "left")
    known = stash(known.where("copies > 1 or component is not null").select("h1", "h2", "rep", F.coalesce("component", "h1").alias("group"), "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    least = known.groupBy("group").agg(F.min("rep").alias("component"))
    facts = known.join(least, "group").select("h1", "h2", "component", "links", "copies")
    # Classes of many copies are few; they are sent to their rows, which then don't all meet in one task.
    total = known.agg(F.sum("copies")).first()[0] or 0
    heavy = F.broadcast(facts.where(F.col("copies") > max(FEW, total // SHARE)).drop("copies"))
    light = facts.where(F.col("copies") <= max(FEW, total // SHARE)).drop("copies")
    rows = sized.withColumn("linkable", F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    rest = rows.join(heavy.select("h1", "h2"), ["h1", "h2"], "left_anti").join(light, ["h1", "h2"], "left")
    rows = rows.join(heavy, ["h1", "h2"]).unionByName(rest)
    component = F.when(F.col("linkable") & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.when(F.col("linkable"), F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), k AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)
), e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k
), r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a
), m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1
), d AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM s JOIN m USING (doc_id) LEFT JOIN d USING (doc_id)
"""
