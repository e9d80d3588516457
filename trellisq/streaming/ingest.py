"""Triples from a folder of N-Triples files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.ntriples import parse_lines


def stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A streaming DataFrame (s, p, o) of the lines of new files."""
    return parse_lines(spark.readStream.text(folder), **options)


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Append what has arrived to the Parquet folder ``path`` and end. Duplicates
    within a run are dropped; readers drop those between runs."""
    found = stream(spark, folder, **options).dropDuplicates(["s", "p", "o"])
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
