"""SimHash near-duplicates: BK-trees over shards of the fingerprints.

Two fingerprints of 64 bits that differ in at most 3 agree in one of four
16-bit blocks, and in one of four 12-bit blocks of the rest. So each distinct
fingerprint goes to 16 shards keyed by 28 agreeing bits, and every pair in
reach meets in one. A shard holds a BK-tree: children hang under the integer
Hamming distance to their parent, and a search follows only the edges within
the radius of the query's own distance. Trees are built where their shard
lies, with the shard's fingerprints as the queries; all trees together grow
with the corpus, so they are never sent to every task. A shard tells only who
is linked to its local group's first member, not every pair.

``similar`` is for a looser bound, a Jaccard similarity of word shingles. It begins
with the trees: the fingerprints of the shingle sets go to the same shards, each
shard tells pairs in reach that span its local groups, and those that the exact
similarity confirms make the first components (``tree_links``). But 3 of 64 bits
can't serve that bound alone, and no number of agreeing bits serves it at every
size: with more documents more bits have to agree, and fewer pairs do. So a
completion follows, which only looks at pairs the trees left apart. Its keys
are BANDS groups of BAND_ROWS least hashes of the shingle set. They bring a pair
at 0.8 together with a probability of 0.998, however many documents there are,
and unrelated ones hardly ever. Of what meets, WIDE words of fingerprint sort
out the unlike by a bound that is 6 standard deviations wide; the rest is
verified by the exact similarity of the shingle sets, in two steps whose rows
grow with the documents, not with their pairs. First each set's nearest ones in
its shard are verified. Then, where a shard still holds sets of different
components within the bound, these sets go to the shard's task, which verifies
all their pairs and tells only the links that join components. A shard with too
many sets or bytes for one task goes as pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from .common import arrow_map, cut, pick, slices
from .components import components

WORDS = 3
RADIUS = 3
SEED = 42
BITS_AT_ONCE = 1 << 14
WIDE = 4
SIMILARITY = 0.8
BANDS = 16
BAND_ROWS = 5
#: Shingles whose least hashes are sought at once.
SHINGLES_AT_ONCE = 1 << 13
#: Ids of removed documents are broadcast up to this many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Fingerprints of one task, over all shards, and (query, node) pairs at once.
TASK_ROWS = 1_000_000
PAIRS_AT_ONCE = 1 << 20
#: Sets, and bytes of sets, of a shard that one task compares; a larger shard goes
#: in blocks. Of its neighbours by fingerprint a set is compared with so many first.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
NEIGHBOURS = 256
FIRST_BLOCK = 1 << 16
#: Links whose components one task finds; more go by rounds of joins.
TASK_LINKS = 1_000_000
#: Bytes of sets that a task of the second step gets, about.
SETS_BYTES = 16 << 20


def _hashes(text: str, words: int) -> np.ndarray:
    """Hashes of the shingles; of the whole sequence if it is shorter than one."""
    parts = text.encode().lower().split()
    joined = b" ".join(parts)
    if len(parts) < words:
        return np.array([xxh64_intdigest(joined, SEED)] if parts else [], "<u8")
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1]
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BITS_AT_ONCE):
        set_bits += np.unpackbits(hashes[at : at + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, words: int = WORDS) -> int:
    return _majority(_hashes(text, words))


def _mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th mix of the hashes."""
    mixed = (hashes + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(29)


def wide_fingerprint(hashes: np.ndarray, count: int) -> list[int]:
    """``count`` fingerprints from different mixes of a shingle set's hashes."""
    return [_majority(_mixed(hashes, i)) for i in range(count)]


#: An odd factor and a summand for each least hash.
_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The candidate keys of a shingle set, as signed longs; none if it is empty."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        mixed = hashes[at : at + SHINGLES_AT_ONCE, None] * _ORDERS[0] + _ORDERS[1]
        # The low bits of a product depend on few bits, so the high ones are folded in.
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return np.array([xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(rows)], np.uint64).view(np.int64).tolist()


def set_key(hashes: np.ndarray) -> int:
    """Names a shingle set (sorted hashes), as a signed long."""
    return int(np.uint64(xxh3_64_intdigest(hashes.astype("<u8").tobytes())).view(np.int64))


def fingerprints(docs: DataFrame, words: int = WORDS, text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(x or "", words) for x in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(pick(docs, doc_id="doc_id", text=text).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, fp long")


def _shards(fp: Column) -> Column:
    """The 16 shard keys of a fingerprint: table number and 28 agreeing bits."""
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * i) - 1) if i else F.lit(0).cast("long")
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (i + 1)), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.shiftleft(F.lit(4 * i + j).cast("long"), 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(sub))
    return F.array(*keys)


class Forest:
    """BK-trees, one for each run of equal ``shard`` (sorted), built level by level."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        first = np.concatenate([[True], shard[1:] != shard[:-1]])
        roots = np.flatnonzero(first)
        self.root = roots[np.cumsum(first) - 1]
        item = np.flatnonzero(~first)
        node = self.root[item]
        edges, children = [], []
        while len(item):
            edge = node * 128 + np.bitwise_count(fp[item] ^ fp[node])
            order = np.argsort(edge, kind="stable")
            item, edge = item[order], edge[order]
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            edges.append(edge[new])
            children.append(item[new])
            node = item[np.flatnonzero(new)[np.cumsum(new) - 1]][~new]
            item = item[~new]
        self.edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.edge)
        self.edge = self.edge[order]
        self.child = (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) in reach of each other, each pair once, in pieces."""
        every = np.arange(len(self.fp))
        waiting = [(every[a : a + PAIRS_AT_ONCE], self.root[a : a + PAIRS_AT_ONCE]) for a in range(0, len(every), PAIRS_AT_ONCE)]
        while waiting:
            query, node = waiting.pop()
            apart = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (apart <= radius) & (query > node)
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edge, node * 128 + np.maximum(apart - radius, 0), "left")
            count = np.searchsorted(self.edge, node * 128 + apart + radius, "right") - low
            for a, b in _pieces(count):
                n = count[a:b]
                at = np.repeat(low[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                if len(at):
                    waiting.append((np.repeat(query[a:b], n), self.child[at]))


def _pieces(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of ``count`` that sum to about PAIRS_AT_ONCE at most."""
    total, a = np.cumsum(count), 0
    while a < len(count):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, "right"))
        b = max(b, a + 1)
        yield a, b
        a = b


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the groups of a and b; labels stay flat and are the least member.
    Gives the places of pairs that span what was merged."""
    spanning = [np.zeros(0, np.int64)]
    while True:
        x, y = label[a], label[b]
        at = np.flatnonzero(x != y)
        if not len(at):
            return np.concatenate(spanning)
        low, high = np.minimum(x, y)[at], np.maximum(x, y)[at]
        order = np.lexsort((low, high))
        at, low, high = at[order], low[order], high[order]
        new = np.concatenate([[True], high[1:] != high[:-1]])
        spanning.append(at[new])
        label[high[new]] = low[new]
        while (label[label] != label).any():
            label[:] = label[label]


def _linked(batches: Iterator[pa.RecordBatch], radius: int, pairs: bool) -> Iterator[pa.RecordBatch]:
    columns = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
    if not columns:
        return
    shard, fp, rep = (np.concatenate(x) for x in zip(*columns, strict=True))
    order = np.lexsort((rep, shard))
    shard, fp, rep = shard[order], fp[order].view(np.uint64), rep[order]
    same = shard[1:] == shard[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    shard, fp, rep = shard[shared], fp[shared], rep[shared]
    if not len(shard):
        return
    label, found = np.arange(len(shard)), []
    for a, b in Forest(shard, fp).links(radius):
        at = join_labels(label, a, b)
        found.append((rep[a[at]], rep[b[at]]))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (rep[:0], rep[:0])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        return
    moved = np.flatnonzero(label != np.arange(len(label)))
    yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], ["a", "b"])


def edges(groups: DataFrame, radius: int = RADIUS, pairs: bool = False) -> DataFrame:
    """(a, b): links that connect the representatives of all fingerprints in
    reach of each other; with ``pairs`` each link is itself in reach. ``groups``
    holds (fp, rep), each fp and rep once."""
    if radius > 3:
        raise ValueError("the shards serve a radius of at most 3 bits")
    spark = groups.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * groups.count() // TASK_ROWS))
    sharded = groups.select(F.explode(_shards(F.col("fp"))).alias("shard"), "fp", "rep").repartition(parts, "shard")
    return arrow_map(sharded, lambda batches: _linked(batches, radius, pairs), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is the smallest
    doc_id reachable over links of at most ``radius`` differing bits.

    A null text or one without words has fingerprint 0, which links like any
    other. Each row has its own fingerprint; rows of equal doc_id may share a
    component through their id. A row without doc_id links to nothing and has
    a null component. Empty table: no rows.
    """
    found = cut(fingerprints(docs, words, text))
    known = found.where("doc_id is not null")
    groups = cut(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    settled = components(edges(groups, radius))
    labelled = groups.join(settled.toDF("rep", "component_id"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    joined = found.join(labelled, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _bound(similarity: float, wide: int) -> int:
    """Differing bits that practically every pair at ``similarity`` keeps within:
    what sets of one size let expect (others differ less) and 6 deviations."""
    apart = acos(2 * similarity / (1 + similarity)) / pi
    bits = 64 * wide
    return int(bits * apart + 6 * sqrt(bits * apart * (1 - apart)))


class Met:
    """Sets that share a shard, in the order of their fingerprints, and whose pairs
    within the bound are listed step by step."""

    def __init__(self, batches: Iterator[pa.RecordBatch], bound: int, similarity: float):
        columns = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        self.some = bool(columns)
        if not columns:
            return
        shard, key, label, n, *wide = (np.concatenate(x) for x in zip(*columns, strict=True))
        wide = [x.view(np.uint64) for x in wide]
        order = np.lexsort((key, *wide[::-1], shard))
        self.shard, self.key, self.label, self.n, self.wide = shard[order], key[order], label[order], n[order], [x[order] for x in wide]
        self.bound, self.similarity = bound, similarity

    def pairs(self, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, differing bits) of sets at most ``most`` places apart."""
        at, step = np.arange(len(self.key)), 1
        while most is None or step <= most:
            at = at[at + step < len(self.key)]
            at = at[self.shard[at] == self.shard[at + step]]
            if not len(at):
                return
            a, b = at, at + step
            bits = sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in self.wide)
            near = (bits <= self.bound) & (np.minimum(self.n[a], self.n[b]) >= self.similarity * np.maximum(self.n[a], self.n[b]) - 1e-9)
            if near.any():
                yield a[near], b[near], bits[near]
            step += 1

    def nearest(self) -> list[np.ndarray]:
        """For each set the nearest one, and the nearest one before it, or -1."""
        far = 64 * len(self.wide) + 1
        least, least_before = np.full(len(self.key), far), np.full(len(self.key), far)
        mate, mate_before = np.full(len(self.key), -1), np.full(len(self.key), -1)
        for a, b, bits in self.pairs(NEIGHBOURS):
            for one, other, low, to in ((b, a, least_before, mate_before), (b, a, least, mate), (a, b, least, mate)):
                closer = bits < low[one]
                low[one[closer]], to[one[closer]] = bits[closer], other[closer]
        return [mate, mate_before]


def _first(batches: Iterator[pa.RecordBatch], bound: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b), a < b: each set's nearest ones, unless one label holds both."""
    met = Met(batches, bound, similarity)
    if not met.some:
        return
    found = [(np.minimum(met.key[some], met.key[to[some]]), np.maximum(met.key[some], met.key[to[some]])) for to in met.nearest() for some in [np.flatnonzero((to >= 0) & (met.label != met.label[to]))]]
    pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in range(2)], ["a", "b"])


def _open_sets(batches: Iterator[pa.RecordBatch], bound: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(shard, key) of the sets that have a mate of another component in their
    shard which the first step didn't verify there."""
    met = Met(batches, bound, similarity)
    if not met.some:
        return
    mate, before = met.nearest()
    flag = np.zeros(len(met.key), bool)
    for a, b, _ in met.pairs():
        new = (met.label[a] != met.label[b]) & (mate[b] != a) & (mate[a] != b) & (before[b] != a)
        flag[a[new]] = flag[b[new]] = True
    yield pa.RecordBatch.from_arrays([pa.array(met.shard[flag]), pa.array(met.key[flag])], ["shard", "key"])


def _joined(batches: Iterator[pa.RecordBatch], bound: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): links that join components. Rows come sorted by task: task, side, key,
    label, set and fingerprint words. Sets of sides 1 and 2 are compared across."""
    rows: list[tuple] = []
    for batch in batches:
        task = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if rows and rows[0][0] != task[x]:
                yield _links_of(rows, bound, similarity)
                rows = []
            some = batch.slice(x, y - x)
            sets = [np.frombuffer(h.as_buffer(), "<u8").copy() for h in some.column(4)]
            rows += zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).to_pylist(), some.column(3).to_pylist(), sets, zip(*(c.to_pylist() for c in some.columns[5:]), strict=True), strict=True)
    if rows:
        yield _links_of(rows, bound, similarity)


def _links_of(rows: list[tuple], bound: int, similarity: float) -> pa.RecordBatch:
    _, side, key, label, sets, wide = zip(*rows, strict=True)
    side, words = np.array(side), np.array(wide, np.int64).view(np.uint64)
    root = np.unique(np.array(label, np.int64), return_inverse=True)[1]
    n = np.array(list(map(len, sets)), np.int64)
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(n) - n
    held = np.zeros(len(names), bool)
    found = []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[(root[j] != root[i]) & ((side[j] + side[i]) % 3 == 0) & (np.minimum(n[j], n[i]) >= similarity * np.maximum(n[j], n[i]) - 1e-9)]
        j = j[np.bitwise_count(words[j] ^ words[i]).sum(axis=1) <= bound]
        if not len(j):
            continue
        own = number[first[i] : first[i] + n[i]]
        held[own] = True
        for x in j.tolist():
            if root[x] == root[i]:
                continue
            common = int(held[number[first[x] : first[x] + n[x]]].sum())
            if common >= similarity * (n[x] + n[i] - common) - 1e-9:
                found.append((key[i], key[x]))
                root[root == root[x]] = root[i]
        held[own] = False
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])


def shingle_sets(keys: DataFrame, groups: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(key, hashes) of these keys: the sorted shingle hashes as bytes. ``groups``
    holds (key, rep) and ``rows`` the representatives' (doc_id, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = {}
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                hashes = np.unique(_hashes(text or "", words))
                # A doc_id may have other texts too.
                if set_key(hashes) == key:
                    found[key] = hashes.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["key", "hashes"])

    wanted = cut(keys.distinct().join(groups.select("key", F.col("rep").alias("doc_id")), "key"))
    few = wanted.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc_id").select("key", "text")
    return cut(arrow_map(texts, sets, "key long, hashes binary").dropDuplicates(["key"]))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: set keys) whose sets have the Jaccard similarity."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            near = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut(arrow_map(both, verified, "a long, b long"))


def _settled(links: DataFrame) -> DataFrame:
    """``components`` of links (cut before) as (key, label), in one task if they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not columns:
            return
        a, b = (np.concatenate(x) for x in zip(*columns, strict=True))
        key, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(key))
        join_labels(label, at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key[label])], ["key", "label"])

    if links.count() > TASK_LINKS:
        return components(links).toDF("key", "label")
    return cut(arrow_map(links.coalesce(1), run, "key long, label long"))


def tree_links(groups: DataFrame, rows: DataFrame, words: int, similarity: float, fp: str = "w0") -> tuple[DataFrame, DataFrame]:
    """The links (a, b: set keys) that the trees find and the exact similarity
    confirms, and the (key, hashes) read for that. They span the sets whose
    fingerprints are in reach of each other; where a spanning pair isn't confirmed,
    others of its group may be, which is left to the completion. ``groups`` holds
    (key, rep) and the fingerprint, ``rows`` the representatives' (doc_id, text)."""
    one = cut(groups.groupBy(F.col(fp).alias("fp")).agg(F.min("key").alias("rep")))
    equal = groups.select("key", F.col(fp).alias("fp")).join(one, "fp").where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    near = edges(one, pairs=True).unionAll(equal)
    near = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = shingle_sets(near.select(F.explode(F.array("a", "b")).alias("key")), groups, rows, words)
    return alike(near, sets, similarity), sets


def similar(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, wide: int = WIDE, text: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with a doc_id: components of documents
    whose shingle sets are alike by ``similarity`` (Jaccard). The trees' pairs are
    verified first, then all pairs with a common key that would join components.

    Documents without words are alike; documents shorter than a shingle count as
    one shingle. Null texts count as empty. Rows of equal doc_id share a component.
    Empty table: no rows. Texts of any length are hashed whole.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(_hashes(x or "", words)) for x in part.column(1).to_pylist()]
            found = np.array([wide_fingerprint(x, wide) for x in sets], np.uint64).reshape(-1, wide).view(np.int64)
            columns = [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([band_keys(x) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(wide))], ["doc_id", "key", "bands", "n", *names])

    names, bound = [f"w{i}" for i in range(wide)], _bound(similarity, wide)
    rows = pick(docs, doc_id="doc_id", text=text).withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    found = cut(arrow_map(rows, run, "doc_id long, key long, bands array<long>, n long, " + ", ".join(f"{n} long" for n in names)))
    groups = cut(found.groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(n).alias(n) for n in ("bands", "n", *names)]))
    links, sets = tree_links(groups, rows, words, similarity)
    grouped = groups.join(_settled(links), "key", "left").withColumn("label", F.coalesce("label", "key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-BANDS * groups.count() // TASK_ROWS))
    sharded = grouped.select(F.explode("bands").alias("shard"), "key", "label", "n", *names)
    large = cut(
        sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("many"), (F.sum("n") * 8).alias("bytes"))
        .where((F.col("many") > BLOCK) | (F.col("bytes") > BLOCK_BYTES))
        .select("shard", F.ceil(F.greatest(F.col("many") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("blocks"), F.ceil(F.col("many") / FIRST_BLOCK).alias("firsts"))
    )
    some_large = large.limit(1).count() > 0
    first = sharded
    if some_large:  # dealt into blocks for the first step, which needs no pair
        first = sharded.join(large, "shard", "left").withColumn("shard", F.when(F.col("firsts") > 1, F.xxhash64("shard", F.pmod(F.xxhash64("key"), "firsts"))).otherwise(F.col("shard")))
    first = first.select("shard", "key", "label", "n", *names).repartition(parts, "shard")
    pairs = cut(arrow_map(first, lambda batches: _first(batches, bound, similarity), "a long, b long").distinct())
    more = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = sets.unionAll(shingle_sets(more.join(sets, "key", "left_anti"), groups, rows, words))
    links = links.unionAll(alike(pairs, sets, similarity))
    settled = _settled(links)
    labelled = groups.join(settled, "key", "left").withColumn("label", F.coalesce("label", "key"))
    shards = labelled.select(F.explode("bands").alias("shard"), "key", "label", "n", *names)
    small = shards.join(large, "shard", "left_anti") if some_large else shards
    flagged = cut(arrow_map(small.repartition(parts, "shard"), lambda batches: _open_sets(batches, bound, similarity), "shard long, key long"))
    tasks = flagged.select(F.col("shard").alias("task"), F.lit(0).alias("side"), "key")
    if some_large:
        mixed = shards.join(large, "shard").groupBy("shard", "blocks").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shard", "blocks")
        dealt = shards.join(mixed, "shard").withColumn("own", F.pmod(F.xxhash64("key"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        tasks = tasks.union(dealt.select(F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")), F.when(F.expr("own = other"), 0).when(F.expr("own < other"), 1).otherwise(2), "key"))
    tasks = cut(tasks)
    if tasks.limit(1).count():
        # In a small shard a set with a mate in reach was read for the trees or as a nearest one.
        known = tasks.select("key").distinct()
        sets = sets.unionAll(shingle_sets(known.join(sets, "key", "left_anti"), groups, rows, words)) if some_large else sets
        full = tasks.join(labelled.select("key", "label", "n", *names), "key").join(sets, "key")
        size = tasks.join(groups.select("key", "n"), "key").agg(F.sum("n")).first()[0] * 8
        full = full.select("task", "side", "key", "label", "hashes", *names).repartition(max(parts, -(-size // SETS_BYTES)), "task").sortWithinPartitions("task")
        settled = _settled(links.unionAll(cut(arrow_map(full, lambda batches: _joined(batches, bound, similarity), "a long, b long"))))
    labelled = groups.select("key", "rep").join(settled, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    # A repeated doc_id can stand for several sets: its least component holds.
    return found.select("doc_id", "key").join(labelled.join(least, "label").select("key", "component_id"), "key").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without those whose group has a smaller doc_id. Rows
    without doc_id stay."""
    names = docs.columns
    gone = cut(similar(docs, words, similarity).where("component_id < doc_id").select(F.col("doc_id").alias("gone")))
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    few = gone.count() <= BROADCAST_IDS
    return flat.join(F.broadcast(gone) if few else gone, F.col(f"c{names.index('doc_id')}").cast("long") == F.col("gone"), "left_anti").toDF(*names)
