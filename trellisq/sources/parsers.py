"""Parsers of triples by file name; others can be registered."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from . import ntriples, turtle


class TripleParser(Protocol):
    """Reads a file or folder as (s, p, o) in canonical text. ``scope`` is put
    before the labels of blank nodes; other options are the parser's own."""

    def __call__(self, spark: SparkSession, path: str, scope: str = "", **options: str) -> DataFrame: ...


PARSERS: dict[str, TripleParser] = {}


def register(suffix: str, parser: TripleParser) -> None:
    """Have files that end in ``.suffix`` read by ``parser``."""
    PARSERS[suffix.lstrip(".")] = parser


def parser_for(path: str, format: str | None = None) -> TripleParser:
    """The parser for a name, which may end in .gz or .bz2 after its suffix."""
    name = format or path.rstrip("/").removesuffix(".gz").removesuffix(".bz2").rpartition(".")[2]
    if name not in PARSERS:
        raise ValueError(f"no parser for {format or path}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[name]


for _suffix in ("nt", "ntriples"):
    register(_suffix, ntriples.read)
register("ttl", turtle.load)
