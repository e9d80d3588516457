"""Helpers that the text operators share: columns, checkpoints, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut, shared_dir

#: The white space that separates words in the word-based operators.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a text column that are turned into Python strings at once.
SLICE_ROWS = 256
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (new name = exact name in ``df``) and no others.

    Columns are taken by position, so that other columns whose names differ
    only in case, or occur twice, do no harm.
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    missing = [name for name in wanted.values() if name not in at]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"c{at[old]}").alias(new) for new, old in wanted.items()])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` such that a task run again reads the same rows in the same order:
    itself if it only scans files, else cut to the shared folder."""
    waiting, names = [df._jdf.queryExecution().optimizedPlan()], set()
    while waiting:
        node = waiting.pop()
        names.add(node.nodeName().split(" ")[0])
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return df if names <= {"Project", "Filter", "Relation", "LogicalRelation", "LogicalRDD"} else cut(df)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, which bounds what Python holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``keep`` and the aliased ``columns``, computed once a row.

    A filter above isn't pushed below a generator's output, as it would be
    below a projection, where the costly columns would be computed again.
    """
    return df.select(*keep, F.inline_outer(F.array(F.struct(*columns))))


def _give_back() -> None:
    """Free memory goes to the system, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches that stay small, on both sides, where texts are long;
    the session keeps the limit. Workers outlive their tasks, so a task gives
    back what it has freed."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_LIMIT).rstrip("bB")) != BATCH_BYTES:
        conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    return df.mapInArrow(run, schema)
