"""What callers may rely on in any engine for triples."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class QueryEngine(Protocol):
    def add(self, triples: Iterable[tuple[object, object, object]]) -> None: ...
    def add_frame(self, triples: DataFrame) -> None: ...
    def load(self, path: str, format: str | None = None, **options: str) -> None: ...
    def match(self, patterns: Iterable[tuple[object, object, object]], select: list[str] | None = None, budget: int | None = None) -> DataFrame: ...
    def sparql(self, query: str) -> DataFrame: ...
    def close(self) -> None: ...
