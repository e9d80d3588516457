"""A time limit for what blocks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def deadline(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Spark jobs that the block starts are cancelled after ``seconds``, and the
    block ends in a TimeoutError. None: no limit. Limits may be nested."""
    if seconds is None:
        yield
        return
    context, group, late = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", threading.Event()
    outer = context.getLocalProperty("spark.jobGroup.id")

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(max(0.0, seconds), stop)
    context.setJobGroup(group, "with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"it took more than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", outer)
    if late.is_set():
        raise TimeoutError(f"it took more than {seconds} seconds")
