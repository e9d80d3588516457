"""RDF terms and their canonical text.

The first character of the text tells the kind: a letter starts an IRI, a
digit or minus an integer, a double quote a literal (``"lex"``, ``"lex"@lang``
or ``"lex"^^type``), ``_:`` a blank node, ``<`` an XML literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Vocabulary IRIs.
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML_LITERAL = RDF + "XMLLiteral"
LANG_STRING = RDF + "langString"

# Derived integer types, whose values are canonical integers here.
INTEGERS = {XSD + t for t in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedInt", "unsignedLong", "unsignedShort", "unsignedByte")}
_INTEGER = re.compile(r"[+-]?\d+\Z")


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    label: str


@dataclass(frozen=True)
class Literal:
    lexical: str
    datatype: str = XSD + "string"
    lang: str = ""


@dataclass(frozen=True)
class Var:
    name: str


Term = Iri | Blank | Literal


def encode(term: Term) -> str:
    """The term's canonical text. Integers lose leading zeros and signs."""
    if isinstance(term, Iri):
        if not term.value[:1].isalpha():
            raise ValueError(f"an IRI starts with a letter: {term.value!r}")
        return term.value
    if isinstance(term, Blank):
        return f"_:{term.label}"
    if term.lang:
        return f'"{term.lexical}"@{term.lang.lower()}'
    if term.datatype in INTEGERS and _INTEGER.match(term.lexical):
        return str(int(term.lexical))
    if term.datatype == XSD + "string":
        return f'"{term.lexical}"'
    if term.datatype == XML_LITERAL and term.lexical.startswith("<"):
        return term.lexical
    return f'"{term.lexical}"^^{term.datatype}'


def decode(text: str) -> Term:
    """The term of a canonical text; ValueError for anything else."""
    head = text[:1]
    if head.isalpha():
        return Iri(text)
    if head == "_" and text[1:2] == ":":
        return Blank(text[2:])
    if head == "<":
        return Literal(text, XML_LITERAL)
    if _INTEGER.match(text) and head != "+":
        return Literal(text, XSD + "integer")
    if head == '"' and len(text) > 1:
        close = text.rfind('"')
        lexical, rest = text[1:close], text[close + 1 :]
        if close and not rest:
            return Literal(lexical)
        if close and rest.startswith("^^"):
            return Literal(lexical, rest[2:])
        if close and rest.startswith("@"):
            return Literal(lexical, LANG_STRING, rest[1:])
    raise ValueError(f"not a term: {text!r}")


def from_python(value: object) -> Term:
    """A term for a plain Python value; terms stay as they are."""
    if isinstance(value, (Iri, Blank, Literal)):
        return value
    if isinstance(value, bool):
        return Literal(str(value).lower(), XSD + "boolean")
    if isinstance(value, int):
        return Literal(str(value), XSD + "integer")
    if isinstance(value, float):
        return Literal(repr(value), XSD + "double")
    if isinstance(value, str):
        return decode(value)
    raise ValueError(f"no term for {value!r}")
