"""Packing: concatenate all documents' tokens and cut at every 4096th.

The first pass turns texts to ids, task by task, and notes for each document
how many ids stand before it in its partition. It is written to the shared
folder, so that a lost executor can't change the order afterwards. Prefix
sums over the partitions' totals (one row a partition) then give every
document's place in the whole stream, and the second pass cuts there: a
document that crosses a border gives one record on each side of it. No row
moves between partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_WORDS, encoder
from .common import arrow_map, cut, pick, slices

WINDOW = 4096
#: Closes every document.
DOCUMENT_END = 2
#: Rows whose chunks are encoded together, within an Arrow batch.
ENCODED_ROWS = 1024
PIECES = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, tokenizer: str, end: int = DOCUMENT_END, text: str = "text", held: int = CACHE_WORDS, at_once: int = ENCODED_ROWS) -> DataFrame:
    """(part, before, doc_id, n, ids) for every row: ids with ``end`` behind
    them, as unsigned 16-bit integers where all fit, else 32-bit ones. ``held`` chunks
    are kept twice and ``at_once`` rows encoded together: less takes less memory and
    more time."""
    model = docs.sparkSession.sparkContext.broadcast(open(tokenizer, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(model.value, by_library=True, held=held)
        part, before = TaskContext.get().partitionId(), 0
        close = np.array([end], "<u4")
        for rows in slices(batches, at_once):
            ids = [np.concatenate([x, close]) for x in to_ids.all([x or "" for x in rows.column(1).to_pylist()])]
            counts = [len(x) for x in ids]
            starts = list(accumulate(counts, initial=before))
            before = starts.pop()
            blobs = [(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), rows.column(0), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    rows = pick(docs, doc_id="doc_id", text=text)
    return arrow_map(rows, run, f"part int, before long, doc_id {rows.dtypes[0][1]}, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = DOCUMENT_END, text: str = "text", held: int = CACHE_WORDS, at_once: int = ENCODED_ROWS) -> DataFrame:
    """One row a piece: doc_id, start (ids of its document before it), length,
    ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Sequences are full but for the last, so padding is below one window. A null
    or empty text packs as its end id alone. Repeated rows are packed again, and
    a row without doc_id keeps null. An empty table gives no pieces. A very long
    text is encoded whole and cut into as many pieces as it needs. Other columns
    may have any names. The stream's order is that of the scan. ``held`` and ``at_once``
    (see ``tokens``) change memory and time only.
    """
    kind = pick(docs, doc_id="doc_id").dtypes[0][1]
    encoded = cut(tokens(docs, tokenizer, end, text, held, at_once))
    totals = {r["part"]: r["total"] for r in encoded.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    order = sorted(totals)
    base = dict(zip(order, accumulate((totals[p] for p in order), initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for part, before, doc, n, blob in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                ids = np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<u2").astype("<u4").tobytes()
                at, start = base[part] + before, 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    for column, x in zip(out, (doc, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset), strict=True):
                        column.append(x)
                    start += length
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (rows.column(2).type, long, long, pa.binary(), long, long, long), strict=True)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return arrow_map(encoded, run, PIECES.format(kind))


def checksums(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 (unsigned) in place of their ids."""
    kept = [c for c in pieces.columns if c != "ids"]
    return pieces.select(*kept[:3], F.crc32("ids").alias("ids_crc32"), *kept[3:])
