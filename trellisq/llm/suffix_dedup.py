"""Suffix-array dedup: bytes of 50-byte strings that a smaller doc_id holds.

No machine can hold the suffix array of a corpus, so equal strings are first
brought together. Of the 20-byte strings inside a window of 50 bytes the one
with the least hash is its anchor: equal windows have equal anchors. Windows
in a row with the same anchor form a stretch; every window lies in exactly
one. So:

1. documents are packed into units, compressed Arrow blocks, and dealt out once;
   they stay where they are from then on, and only answers come to them;
2. units send the hashes of whole documents; all copies but the smallest document
   lose their bytes and take no part in what follows;
3. units cut their documents into stretches and send the anchors' hashes to the
   hashes' buckets, one record for an anchor that several documents of the task
   hold; buckets answer which anchors stand in several documents, and which of
   them are hot: stand in over HOT places;
4. units send the hashes of the stretches so marked to their anchor's bucket; of
   equal stretches all but those of the smallest document lose their bytes, and
   those that share an anchor with a different one are marked again. A task
   settles its own equal stretches before it sends anything. The windows of a hot
   anchor's stretches go by their own hashes instead, to as many buckets as there
   are, so that no bucket gets all of them;
5. units send the stretches marked again, whole; a bucket builds the two-stage
   suffix array of those that share an anchor, and finds by adjacent common
   prefixes the windows that stand in a smaller document;
6. units take the windows' bytes out of their documents.

So the suffix array decides about stretches that differ but share an anchor;
copies of documents and of stretches, and hot windows, are settled by hash. All
steps are exact: a collision of anchor hashes only makes a bucket look at more,
and stretches or windows count as equal if 96 bits of two hashes are. Arrays
travel in compressed blocks, a row for each task and bucket; what a task holds
is bounded by FLUSH_BYTES and PART_BYTES, or by one document. A document of any
length is cut CUT_BYTES at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest, xxh64_intdigest

from .common import arrow_map, repeatable, slices
from .suffix_array import shared_with_previous, suffix_array, words

SPAN = 50
ANCHOR = 20
#: Text bytes that are cut at once, gathered before a flush, and sent to a bucket.
CUT_BYTES = 1 << 20
FLUSH_BYTES = 8 << 20
PART_BYTES = 16 << 20
#: Text bytes of a unit, and units of a partition where there is enough text.
UNIT_BYTES = 2 << 20
LEAST_UNIT_BYTES = 256 << 10
UNITS = 2
#: Text of one suffix array, unless a single anchor has more, which HOT bounds.
ARRAY_BYTES = 1 << 18
#: An anchor with more places than this goes by windows.
HOT = 1 << 12
#: Stands for a document without doc_id, which comes after all others.
NO_ID = 2**63 - 1
#: kind 0: a block for a bucket; kind 1: a block for a unit; kind 3: a block for a
#: bucket, of things that are only settled by their hashes.
ROWS = "kind int, bucket int, unit long, block binary"
ANSWERS = "unit long, block binary"
NO_KEYS, NO_PLACES = np.zeros(0, "<u8"), np.zeros(0, "<u4")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sq", x.dtype.str[1:].encode().ljust(3), len(x)) for x in arrays)
    return zstandard.compress(head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays), 3)


def unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(block)
    at, out = 1 + 11 * data[0], []
    for i in range(data[0]):
        kind, n = struct.unpack_from("<3sq", data, 1 + 11 * i)
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(data, dtype, n, at))
        at += n * dtype.itemsize
    return out


def stretches(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end, anchor hash) of each stretch: its windows start
    from start up to before end. Where a document is cut doesn't depend on the
    others. A run of one byte, or of a short period, is one stretch."""
    found = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64)]
    group: list[int] = []
    size = 0

    def cut(parts: list[bytes], numbers: list[int], offsets: list[int]) -> None:
        for column, x in zip(found, _cut(parts, numbers, offsets, span), strict=True):
            column.append(x)

    for i, text in enumerate(texts):
        if len(text) < span:
            continue
        if group and size + len(text) > CUT_BYTES:
            cut([texts[j] for j in group], group, [0] * len(group))
            group, size = [], 0
        if len(text) > CUT_BYTES:
            for at in range(0, len(text) - span + 1, CUT_BYTES):
                cut([text[at : at + CUT_BYTES + span - 1]], [i], [at])
        else:
            group.append(i)
            size += len(text)
    if group:
        cut([texts[j] for j in group], group, [0] * len(group))
    return tuple(np.concatenate(x) for x in found)


def _cut(parts: list[bytes], numbers: list[int], offsets: list[int], span: int) -> tuple[np.ndarray, ...]:
    n = sum(map(len, parts))
    data = b"".join([*parts, b"\0" * 16])
    grams = n - ANCHOR + 1
    at = words(data, grams + ANCHOR - 8)
    hashes = at[:grams] * MIX[0]
    for offset in [*range(8, ANCHOR - 8, 8), ANCHOR - 8]:
        hashes ^= hashes >> np.uint64(31)
        hashes += at[offset : offset + grams]
        hashes *= MIX[1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= MIX[2]
    hashes ^= hashes >> np.uint64(32)
    # The hash's low half, then the place: the least is the leftmost of equal hashes.
    least = hashes << np.uint64(32) | np.arange(grams, dtype=np.uint64)
    width, reach = span - ANCHOR + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.array(list(map(len, parts)))
    owner = np.repeat(np.arange(len(parts)), lengths)
    inside = owner[: len(anchor)] == owner[span - 1 :]
    starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])]))
    # Places in a row with one anchor text are one stretch.
    key = hashes[anchor[starts]]
    starts = starts[np.concatenate([[True], (key[1:] != key[:-1]) | (inside[starts][1:] != inside[starts][:-1])])]
    ends = np.append(starts[1:], len(anchor))
    kept = inside[starts]
    starts, ends = starts[kept], ends[kept]
    part = owner[starts]
    shift = np.array(offsets)[part] - (np.cumsum(lengths) - lengths)[part]
    return np.array(numbers)[part], starts + shift, ends + shift, hashes[anchor[starts]]


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["kind", "bucket", "unit", "block"])


def _answers(blocks: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(list(blocks.values()), pa.binary())], ["unit", "block"])


def _bounds(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _ranges(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of each run of equal keys."""
    edges = [*_bounds(sorted_keys).tolist(), len(sorted_keys)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _ordinals(doc: np.ndarray) -> np.ndarray:
    first = _bounds(doc)
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))


# ---- units


def _store(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def _units(batches: Iterator[pa.RecordBatch], at_text: int, unit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 1: (unit, block), of about ``unit_bytes`` of text or one document."""
    serial = TaskContext.get().partitionId() << 32
    for part in slices(batches):
        lengths = [x or 0 for x in pc.binary_length(part.column(at_text)).to_pylist()]
        blocks: dict[int, bytes] = {}
        start = size = 0
        for i, length in enumerate([*lengths, 0]):
            # The last documents go whatever their size; texts may be empty.
            if i > start and (i == len(lengths) or size + length > unit_bytes):
                # A copy, so that the block doesn't hold the rest of the slice.
                blocks[serial] = _store(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.slice(start, i - start).columns], part.schema.names))
                serial += 1
                start, size = i, 0
            size += length
        yield from _answers(blocks)


class Unit:
    """A unit's documents: ids (NO_ID for null) and texts as bytes."""

    def __init__(self, unit: int, block: bytes, at_id: int, at_text: int):
        self.unit, self.batch = unit, _open(block)
        self.ids = [NO_ID if x is None else int(x) for x in self.batch.column(at_id).to_pylist()]
        self.texts = [(x or "").encode() for x in self.batch.column(at_text).to_pylist()]
        self.size = sum(map(len, self.texts))


def _lots(batches: Iterator[pa.RecordBatch], at_id: int, at_text: int, every: bool = False) -> Iterator[list[tuple[Unit, list[bytes]]]]:
    """Units with the blocks that a third column holds for them, in bounded lots.
    With that column, units without blocks are left out, unless ``every`` is set."""
    lot, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            blocks = batch.column(2)[i].as_py() or [] if batch.num_columns > 2 else []
            if batch.num_columns > 2 and not blocks and not every:
                continue
            unit = Unit(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), at_id, at_text)
            lot.append((unit, blocks))
            size += unit.size
            if size >= FLUSH_BYTES:
                yield lot
                lot, size = [], 0
    if lot:
        yield lot


# ---- steps 2 to 6


def _copies(batches: Iterator[pa.RecordBatch], parts: int, at_id: int, at_text: int) -> Iterator[pa.RecordBatch]:
    """Step 2, at the units: hashes of whole documents for buckets, and for units
    those that a smaller document of the lot equals."""
    for lot in _lots(batches, at_id, at_text):
        rows = [(unit, i, d, x) for unit, _ in lot for i, (d, x) in enumerate(zip(unit.ids, unit.texts, strict=True)) if len(x) >= SPAN]
        hashes = np.array([xxh3_128_intdigest(x).to_bytes(16, "little") for *_, x in rows], "V16").view("<u8").reshape(-1, 2)
        ids, units, place, length = (np.array(x, np.int64) for x in ([r[2] for r in rows], [r[0].unit for r in rows], [r[1] for r in rows], [len(r[3]) for r in rows]))
        gone = Spans()
        held = Places(hashes[:, 0].copy(), hashes[:, 1].copy(), ids, units, place, np.zeros(len(rows), np.int64), length, gone)
        yield _record([*_for_units(gone, parts), *_for_buckets(3, held, parts)])


def _anchors(batches: Iterator[pa.RecordBatch], parts: int, at_id: int, at_text: int) -> Iterator[pa.RecordBatch]:
    """Step 3, at the units: anchor lists for buckets, and for units the stretches
    whose anchor another document of the lot has too."""
    for lot in _lots(batches, at_id, at_text, every=True):
        texts = []
        for unit, blocks in lot:
            copies = set(np.concatenate([unpack(x)[0] for x in blocks]).tolist()) if blocks else set()
            texts += [b"" if i in copies else x for i, x in enumerate(unit.texts)]
        doc, _, _, key = stretches(texts)
        ids = np.array([d for unit, _ in lot for d in unit.ids], np.int64)
        units = np.array([unit.unit for unit, _ in lot for _ in unit.ids], np.int64)
        place = np.array([i for unit, _ in lot for i in range(len(unit.ids))], "<u4")
        ordinal = _ordinals(doc).astype("<u4")
        order = np.argsort(key)
        first = _bounds(key[order])
        count = np.diff(np.append(first, len(key)))
        several, lead, places = np.zeros(len(key), bool), np.zeros(len(key), bool), np.zeros(len(key), "<u4")
        if len(key):
            found = ids[doc[order]]
            several[order] = np.repeat(np.minimum.reduceat(found, first) != np.maximum.reduceat(found, first), count)
            lead[order[first]] = True
            places[order[first]] = count
        rows = []
        at = np.flatnonzero(several)
        for a, b in _ranges(units[doc[at]]):
            some = at[a:b]
            rows.append((1, int(some[0]) % parts, int(units[doc[some[0]]]), pack(place[doc[some]], ordinal[some], NO_KEYS)))
        # Which units hold a shared anchor, for the answer that it is hot.
        shared = np.unique(np.stack([key[at], units[doc[at]].astype(np.uint64)], axis=1), axis=0)
        bucket = _bucket(key, parts)
        at = np.flatnonzero(~several | lead)
        at = at[np.argsort(bucket[at], kind="stable")]  # by bucket, then document and ordinal
        holds = _bucket(shared[:, 0], parts)
        shared = shared[np.argsort(holds, kind="stable")]
        holds = np.sort(holds)
        for a, b in _ranges(bucket[at]):
            some = at[a:b]
            alone = some[~several[some]]
            held, local = np.unique(doc[alone], return_inverse=True)
            many = some[several[some]]
            own = shared[slice(*np.searchsorted(holds, [bucket[some[0]], bucket[some[0]] + 1]))]
            rows.append((0, int(bucket[some[0]]), 0, pack(_low(key[alone]), local.astype("<u2" if len(held) < 65536 else "<u4"), _narrow(ordinal[alone]), ids[held], units[held], place[held], _low(key[many]), places[many], _low(own[:, 0]), own[:, 1].astype("<i8"))))
        yield _record(rows)


def _bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _low(key: np.ndarray) -> np.ndarray:
    """The hash's low half; the high half chose the bucket."""
    return (key & np.uint64(0xFFFFFFFF)).astype("<u4")


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype("<u2") if len(x) and x.max() < 65536 else x


def _passed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows that are for units already."""
    rows = [i for i, k in enumerate(batch.column(0).to_pylist()) if k == 1]
    if rows:
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(rows)) for i in (2, 3)], ["unit", "block"])


def _repeated(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Step 3, at the buckets: the stretches of each unit to look at, and the
    numbers that tell its hot anchors."""
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    shared: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint32, np.uint32, np.uint32, np.int64)]
    bucket = 0
    for batch in batches:
        yield from _passed(batch)
        for i, kind in enumerate(batch.column(0).to_pylist()):
            if not kind:
                bucket = batch.column(1)[i].as_py()
                key, local, ordinal, ids, units, place, *rest = unpack(batch.column(3)[i].as_py())
                for column, x in zip(columns, (key, ids[local], units[local], place[local], ordinal.astype("<u4")), strict=True):
                    column.append(x)
                for column, x in zip(shared, rest, strict=True):
                    column.append(x)
    if not columns[0]:
        return
    key, ids, units, place, ordinal = (np.concatenate(c) for c in columns)
    many, counts, held, holder = (np.concatenate(c) for c in shared)
    order = np.argsort(key)
    first = _bounds(key[order])
    count = np.diff(np.append(first, len(key)))
    names, which = np.unique(np.concatenate([key[order[first]], many]), return_inverse=True)
    total = np.bincount(which, np.concatenate([count, counts.astype(np.int64)]), len(names))
    hot = names[total > limit]
    answers: dict[int, list[np.ndarray]] = {}
    if len(first):
        found = ids[order]
        several = np.minimum.reduceat(found, first) != np.maximum.reduceat(found, first)
        # A record without a document stands for two of another task.
        several |= np.isin(key[order[first]], many)
        at = order[np.repeat(several, count)]
        at = at[np.lexsort((ordinal[at], place[at], units[at]))]
        answers = {int(units[at[a]]): [place[at[a:b]], ordinal[at[a:b]], NO_KEYS] for a, b in _ranges(units[at])}
    some, among = np.isin(held, hot), np.isin(key, hot)
    pairs = np.unique(np.stack([np.concatenate([holder[some], units[among]]), np.concatenate([held[some], key[among]]).astype(np.int64)], axis=1), axis=0)
    for a, b in _ranges(pairs[:, 0]):
        answers.setdefault(int(pairs[a, 0]), [NO_PLACES, NO_PLACES, NO_KEYS])[2] = pairs[a:b, 1].astype("<u8") << np.uint64(32) | np.uint64(bucket)
    yield from _answers({unit: pack(*x) for unit, x in answers.items()})


class Spans:
    """Byte ranges (unit, document, start, end), gathered as arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, unit: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        if len(unit):
            self.parts.append((unit.astype("<i8"), doc.astype("<u4"), start.astype("<i8"), end.astype("<i8")))

    def blocks(self) -> dict[int, bytes]:
        """Unit -> its ranges; of ranges of a document that meet, their union."""
        if not self.parts:
            return {}
        unit, doc, start, end = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((start, doc, unit))
        unit, doc, start, end = unit[order], doc[order], start[order], end[order]
        out = {}
        for a, b in _ranges(unit):
            out[int(unit[a])] = pack(doc[a:b], start[a:b], end[a:b])
        return out


class Places:
    """Stretches with their places, equal ones settled; numpy arrays throughout.

    Stretches are told apart by the hashes of their content and their anchor,
    96 bits at least. Of equal ones those of the smallest document stay, the others'
    bytes go to ``gone``. What stays is in the order of the anchors' hashes;
    entry i holds the places from first[i] up to before first[i + 1].
    """

    def __init__(self, keys: np.ndarray, hashes: np.ndarray, ids: np.ndarray, unit: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, gone: Spans):
        order = np.argsort(hashes)
        first = _changes(hashes[order], keys[order])
        count = np.diff(np.append(first, len(order)))
        least = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
        late = ids[order] > np.repeat(least, count)
        at = order[late]
        gone.add(unit[at], doc[at], start[at], start[at] + length[at])
        at = order[~late]
        at = at[np.lexsort((hashes[at], keys[at]))]
        self.first = np.append(_changes(keys[at], hashes[at]), len(at))
        lead = at[self.first[:-1]]
        self.at, self.lead = at, lead
        self.keys, self.hashes, self.ids = keys[lead], hashes[lead], ids[lead]
        self.unit, self.doc, self.start, self.length = unit[at], doc[at], start[at], length[at]

    def places(self, some: np.ndarray) -> np.ndarray:
        """Indexes of all places of these entries, in order."""
        counts = self.first[some + 1] - self.first[some]
        return np.repeat(self.first[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())

    def shared(self) -> np.ndarray:
        """Entries whose anchor a different entry has too."""
        same = self.keys[1:] == self.keys[:-1]
        return np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(self.keys) else np.zeros(0, np.int64)


def _changes(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the one before."""
    n = len(sorted_keys[0])
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])])) if n else np.zeros(0, np.int64)


def _marked(lot: list[tuple[Unit, list[bytes]]], parts: int, by_start: bool) -> tuple[list[bytes], list[np.ndarray]]:
    """The marked stretches of a lot's units: contents, and keys, hashes, ids,
    unit, doc, start, length, and whether the anchor is hot. Marks name a stretch
    by document and ordinal, or by document and start."""
    contents: list[bytes] = []
    columns: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64, bool)]
    for unit, blocks in lot:
        marks = [unpack(x) for x in blocks]
        if not marks:
            continue
        place, which, hot = (np.concatenate(c) for c in zip(*(x[:3] for x in marks), strict=True))
        place, which = place.astype(np.int64), which.astype(np.int64)
        wanted = np.zeros(len(unit.texts), bool)
        wanted[place] = True
        texts = unit.texts
        doc, start, end, key = stretches([x if w else b"" for x, w in zip(texts, wanted.tolist(), strict=True)])
        if by_start:
            at = np.searchsorted(doc << 40 | start, place << 40 | which)
        else:
            at = np.searchsorted(doc, np.arange(len(texts)))[place] + which
        at = np.unique(at)
        contents += [texts[i][a:b] for i, a, b in zip(doc[at].tolist(), start[at].tolist(), (end[at] + SPAN - 1).tolist(), strict=True)]
        ids = np.array(unit.ids, np.int64)[doc[at]]
        named = _low(key[at]).astype(np.uint64) << np.uint64(32) | _bucket(key[at], parts).astype(np.uint64)
        heat = np.isin(named, hot) if not by_start else np.zeros(len(at), bool)
        for column, x in zip(columns, (key[at], ids, np.full(len(at), unit.unit), doc[at], start[at], end[at] + SPAN - 1 - start[at], heat), strict=True):
            column.append(x)
    key, *rest = (np.concatenate(c) for c in columns)
    return contents, [key, np.fromiter(map(xxh3_64_intdigest, contents), np.uint64, len(contents)), *rest]


def _for_units(gone: Spans, parts: int) -> list[tuple]:
    return [(1, unit % parts, unit, block) for unit, block in gone.blocks().items()]


def _for_buckets(kind: int, held: Places, parts: int, contents: list[bytes] | None = None, cold: np.ndarray | None = None) -> list[tuple]:
    """Rows of places for their keys' buckets, in the order of the documents: low
    key, document, start (from the one before), length, hash, and the documents'
    ids, units and places. With ``contents`` (by place before Places sorted them)
    their bytes stand instead of the hashes. ``cold``: only these places."""
    key, hashes = (np.repeat(x, np.diff(held.first)) for x in (held.keys, held.hashes))
    ids = np.repeat(held.ids, np.diff(held.first))
    bucket = _bucket(key, parts)
    order = np.lexsort((held.start, held.doc, held.unit, bucket))
    if cold is not None:
        order = order[cold[held.at[order]]]
    rows = []
    for a, b in _ranges(bucket[order]):
        some = order[a:b]
        unit, doc, start = held.unit[some], held.doc[some], held.start[some]
        first = _changes(unit, doc)
        local = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(some))))
        step = np.diff(start, prepend=0)
        step[first] = start[first]
        last = hashes[some] if contents is None else np.frombuffer(b"".join([contents[i] for i in held.at[some].tolist()]), "u1")
        rows.append((kind, int(bucket[some[0]]), 0, pack(_low(key[some]), _narrow(local.astype("<u4")), _narrow(step.astype("<u4")), _narrow(held.length[some].astype("<u4")), last, ids[some[first]], unit[first], doc[first].astype("<u4"))))
    return rows


def _digests(batches: Iterator[pa.RecordBatch], parts: int, at_id: int, at_text: int) -> Iterator[pa.RecordBatch]:
    """Step 4, at the units: hashes of stretches, and of hot anchors' windows, for
    buckets, and for units what a smaller document of the lot holds."""
    for lot in _lots(batches, at_id, at_text):
        gone = Spans()
        contents, (*columns, hot) = _marked(lot, parts, by_start=False)
        held = Places(*columns, gone)
        rows = _for_buckets(0, held, parts, cold=~hot)
        warm = np.flatnonzero(hot[held.at])
        for a in range(0, len(warm), HOT):
            some = warm[a : a + HOT]
            rows += _for_buckets(3, _window_places(held, some, contents, gone), parts)
        yield _record([*_for_units(gone, parts), *rows])


def _window_places(held: Places, some: np.ndarray, contents: list[bytes], gone: Spans) -> Places:
    """The windows of these places, by two hashes of their own."""
    ids = np.repeat(held.ids, np.diff(held.first))[some]
    count = held.length[some] - SPAN + 1
    one, two = ([h(x[i : i + SPAN]) for x in (contents[j] for j in held.at[some].tolist()) for i in range(len(x) - SPAN + 1)] for h in (xxh3_64_intdigest, xxh64_intdigest))
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return Places(np.array(one, np.uint64), np.array(two, np.uint64), np.repeat(ids, count), np.repeat(held.unit[some], count), np.repeat(held.doc[some], count), np.repeat(held.start[some], count) + inner, np.full(len(inner), SPAN), gone)


def _gathered(blocks: list[list[np.ndarray]], gone: Spans) -> Places:
    """Blocks of places as one, equal stretches settled."""
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64)
    columns: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for key, local, step, length, hashes, ids, unit, doc in blocks:
        start = np.cumsum(step, dtype=np.int64)
        first = _bounds(local)
        start -= np.repeat(start[first] - step[first], np.diff(np.append(first, len(local))))
        for column, x, kind in zip(columns, (key, hashes, ids[local], unit[local], doc[local], start, length), kinds, strict=True):
            column.append(x.astype(kind))
    return Places(*(np.concatenate(c) for c in columns), gone)


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps 2 and 4, at the buckets: kind 1, spans of each unit; kind 2, the
    stretches of each unit to send whole."""
    blocks: dict[int, list[list[np.ndarray]]] = {0: [], 3: []}
    for batch in batches:
        for passed in _passed(batch):
            yield _kinds(1, passed)
        for i, kind in enumerate(batch.column(0).to_pylist()):
            if kind != 1:
                blocks[kind].append(unpack(batch.column(3)[i].as_py()))
    gone = Spans()
    _gathered(blocks[3], gone)
    held = _gathered(blocks[0], gone)
    at = held.places(held.shared())
    marks = Spans()
    marks.add(held.unit[at], held.doc[at], held.start[at], held.start[at])
    for kind, spans in ((1, gone), (2, marks)):
        for answer in _answers(spans.blocks()):
            yield _kinds(kind, answer)


def _kinds(kind: int, answer: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * answer.num_rows, pa.int32()), *answer.columns], ["kind", "unit", "block"])


def _contents(batches: Iterator[pa.RecordBatch], parts: int, at_id: int, at_text: int) -> Iterator[pa.RecordBatch]:
    """Step 5, at the units: stretches, whole, for buckets."""
    for lot in _lots(batches, at_id, at_text):
        contents, (*columns, _) = _marked(lot, parts, by_start=True)
        held = Places(*columns, Spans())  # equal ones are of one document here
        yield _record(_for_buckets(0, held, parts, contents))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5, at the buckets: the spans of each unit whose windows a smaller
    document holds."""
    blocks: list[list[np.ndarray]] = []
    contents: dict[int, bytes] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            *block, data, ids, unit, doc = unpack(batch.column(3)[i].as_py())
            sizes = block[3].astype(np.int64)
            ends, data = np.cumsum(sizes), data.tobytes()
            texts = [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            hashes = np.fromiter(map(xxh3_64_intdigest, texts), np.uint64, len(texts))
            contents.update(zip(hashes.tolist(), texts, strict=True))
            blocks.append([*block, hashes, ids, unit, doc])
    held = _gathered(blocks, gone := Spans())
    found: list[tuple[int, int, int]] = []
    for some in _shared_anchors(held):
        texts = [contents[h] for h in held.hashes[some].tolist()]
        found += [(int(some[i]), a, b) for i, a, b in _windows(texts, held.ids[some])]
    if found:
        entry, a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
        counts = held.first[entry + 1] - held.first[entry]
        at = held.places(entry)
        gone.add(held.unit[at], held.doc[at], held.start[at] + np.repeat(a, counts), held.start[at] + np.repeat(b, counts))
    yield from _answers(gone.blocks())


def _shared_anchors(held: Places) -> Iterator[np.ndarray]:
    """Entries whose anchor another entry has too, in lots of about ARRAY_BYTES;
    all entries of an anchor are in one lot."""
    some = held.shared()
    lot, size = 0, 0
    sizes = held.length[held.first[some]]
    for a, b in _ranges(held.keys[some]):
        size += int(sizes[a:b].sum())
        if size >= ARRAY_BYTES:
            yield some[lot:b]
            lot, size = b, 0
    if lot < len(some):
        yield some[lot:]


def _windows(texts: list[bytes], ids: np.ndarray, span: int = SPAN) -> Iterator[tuple[int, int, int]]:
    """(text, start, end): spans of each text whose windows stand in a text with
    a smaller id, by the suffix array of them all."""
    joined = np.frombuffer(b"\0".join(texts), np.uint8)
    lengths = np.array(list(map(len, texts)), np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[:-1]
    offset = np.cumsum(lengths + 1) - lengths - 1
    array = suffix_array(joined, span)
    whole = np.arange(len(joined)) - offset[owner] + span <= lengths[owner]
    first = np.flatnonzero(~shared_with_previous(joined, array, span))
    rank = np.where(whole[array], ids[owner[array]], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(array))))
    late = np.zeros(len(joined), bool)
    late[array] = whole[array] & (rank > least)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], late.view(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        i = int(owner[a])  # windows of two texts never touch: a separator is no start
        yield i, a - int(offset[i]), b - 1 - int(offset[i]) + span


def merge(spans: np.ndarray) -> list[tuple[int, int]]:
    """(start, end, start, end, ...) as disjoint maximal spans, in order."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    if not len(pairs):
        return []
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
    starts = pairs[new, 0]
    ends = reach[np.append(np.flatnonzero(new)[1:], len(pairs)) - 1]
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def _applied(batches: Iterator[pa.RecordBatch], at_id: int, at_text: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    """Step 6: the documents' columns, n_bytes, spans and kept."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for row in range(batch.num_rows):
            unit = Unit(batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), at_id, at_text)
            blocks = [unpack(x) for x in batch.column(2)[row].as_py() or []]
            doc, start, end = (np.concatenate(x) for x in zip(*blocks, strict=True)) if blocks else [np.zeros(0, np.int64)] * 3
            order = np.lexsort((end, start, doc))
            doc, pairs = doc[order], np.stack([start[order], end[order]], axis=1)
            first = np.searchsorted(doc, np.arange(len(unit.texts) + 1))
            removed, kept = [], []
            for i, data in enumerate(unit.texts):
                spans = merge(pairs[first[i] : first[i + 1]])
                pieces, at = [], 0
                for a, b in spans:
                    pieces.append(data[at:a])
                    at = b
                left = b"".join([*pieces, data[at:]])
                removed.append([{"start": a, "end": b} for a, b in spans])
                kept.append(left.decode(errors="ignore") if as_text else left)
            sizes = pa.array(list(map(len, unit.texts)), pa.int64())
            names = [*(f"c{i}" for i in range(unit.batch.num_columns)), "n_bytes", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([*unit.batch.columns, sizes, pa.array(removed, kind), pa.array(kept, pa.string() if as_text else pa.binary())], names)


def remove_repeats(docs: DataFrame, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... in order, then n_bytes (long), spans
    (array of removed byte ranges, start and end) and kept: the bytes that are
    left (binary, as a cut can fall inside a character; ``as_text`` gives a
    string without such halves).

    Bytes go that a 50-byte string covers which also starts in a document with a
    smaller doc_id. A null text counts as empty. Rows of equal doc_id are one
    document: they take nothing from each other. Rows without doc_id come after
    all others and take nothing from any. An empty table gives no rows. Texts of
    any length are treated whole, though a task holds one at a time. An anchor
    with more than ``hot`` places goes by windows, with the same result.
    """
    spark = docs.sparkSession
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = names.index("doc_id"), names.index("text")
    size = flat.agg(F.sum(F.octet_length(f"c{at_text}"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    unit_bytes = min(UNIT_BYTES, max(LEAST_UNIT_BYTES, size // (UNITS * parts)))
    # One exchange, which all joins on the unit read; they move the answers only.
    # Left joins keep it the same everywhere: others would add a filter below it.
    units = arrow_map(repeatable(flat), lambda b: _units(b, at_text, unit_bytes), ANSWERS).repartition(parts, "unit")

    def answered(found: DataFrame) -> DataFrame:
        blocks = found.repartition(parts, "unit").groupBy("unit").agg(F.collect_list("block").alias("blocks"))
        return units.join(blocks.hint("shuffle_hash"), "unit", "left").select("unit", F.col("block"), "blocks")

    def at_buckets(df: DataFrame, step: Callable, settle: Callable, schema: str = ANSWERS) -> DataFrame:
        return arrow_map(arrow_map(df, lambda b: step(b, parts, at_id, at_text), ROWS).repartitionById(parts, F.col("bucket")), settle, schema)

    copies = at_buckets(units, _copies, _equal, f"kind int, {ANSWERS}").drop("kind")
    marked = at_buckets(answered(copies), _anchors, lambda b: _repeated(b, hot))
    equal = at_buckets(answered(marked), _digests, _equal, f"kind int, {ANSWERS}")
    windows = at_buckets(answered(equal.where("kind = 2").drop("kind")), _contents, _settled)
    gone = copies.unionByName(equal.where("kind = 1").drop("kind")).unionByName(windows)
    columns = ", ".join(f"{name} {kind}" for name, kind in flat.dtypes)
    return arrow_map(answered(gone), lambda b: _applied(b, at_id, at_text, as_text), f"{columns}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}")


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row; see ``remove_repeats``."""
    at = docs.columns.index("doc_id")
    return remove_repeats(docs, hot=hot).select(F.col(f"c{at}").alias("doc_id"), "n_bytes", "spans", "kept")
