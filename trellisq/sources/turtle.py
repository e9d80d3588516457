"""Turtle documents to canonical triples.

A document can't be cut into lines, so each file is one row; files are read
in parallel. The parser shares the term syntax of the query parser.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.terms import Blank, Iri, Literal, encode
from ..plans.algebra import Triple
from ..plans.parser import Parser, SparqlError


class Document(Parser):
    """One document. Nodes without a label are named after the document's text."""

    def __init__(self, text: str, scope: str = "", base: str = ""):
        super().__init__(text)
        self.scope, self.base = scope, base
        self.name = hashlib.sha1(text.encode()).hexdigest()[:16]

    def hidden(self) -> Blank:
        self.fresh += 1
        return Blank(f"{self.scope}d{self.name}n{self.fresh}")

    def term(self, variables: bool = True) -> object:
        kind, text = self.peek()
        if kind == "var":
            raise SparqlError(f"a document has no variables, but {text}")
        if kind == "blank":
            self.next()
            return Blank(self.scope + text[2:])
        return super().term(variables)

    def directive(self) -> bool:
        kind, text = self.peek()
        word = text.lstrip("@").upper()
        if not (kind == "lang" and text in ("@prefix", "@base") or kind == "word" and word in ("PREFIX", "BASE")):
            return False
        self.next()
        if word == "BASE":
            self.base = self.iri_token()
        else:
            kind, name = self.next()
            if kind != "name" or not name.endswith(":"):
                raise SparqlError(f"not a prefix: {name!r}")
            self.prefixes[name[:-1]] = self.iri_token()
        if text.startswith("@"):
            self.need(".")
        return True

    def document(self) -> list[tuple[str, str, str]]:
        found: list = []
        while self.peek()[0] != "end":
            if self.directive():
                continue
            inner = self.sees("[")
            subject = self.node(found)
            if not (inner and self.sees(".")):
                self.properties(subject, found)
            self.need(".")
        for t in found:
            if not isinstance(t, Triple) or isinstance(t.s, Literal) or not isinstance(t.p, Iri):
                raise SparqlError("a statement is a subject, a predicate and objects")
        return list(dict.fromkeys(tuple(encode(x) for x in (t.s, t.p, t.o)) for t in found))


def parse(text: str, scope: str = "", base: str = "") -> list[tuple[str, str, str]]:
    """The triples of a document, each once."""
    return Document(text, scope, base).document()


def load(spark: SparkSession, path: str, scope: str = "", base: str = "") -> DataFrame:
    """The set of triples of a file or folder of Turtle documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rows = parse(text or "", scope, base)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["s", "p", "o"])

    found = spark.read.text(path, wholetext=True).select("value").mapInArrow(run, "s string, p string, o string")
    return found.dropDuplicates(["s", "p", "o"])
