"""Typed columns: how a variable or an expression is held in a DataFrame.

``key`` is a raw key column whose IRI is ``prefix`` + key; ``int``, ``dec``,
``dbl``, ``str``, ``bool`` and ``time`` are native columns; ``iri`` is an IRI's
text; ``any`` is a term's canonical text. An error is NULL, as in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import RDF, XSD, Iri, Literal, Term, encode

NUMERIC = ("int", "dec", "dbl")
#: Datatype IRIs of native kinds.
DATATYPES = {"int": XSD + "integer", "dec": XSD + "decimal", "dbl": XSD + "double", "str": XSD + "string", "bool": XSD + "boolean", "time": XSD + "dateTime"}
TIME = "yyyy-MM-dd'T'HH:mm:ss"
_NUMBER_TAIL = "(integer|decimal|double|float|int|long|short|byte)$"
#: A typed literal's text, datatype and language inside a canonical text.
_LEX, _TYPE, _LANG = r'(?s)^"(.*)"(?:\^\^[^"]*|@[^"]*)?$', r'(?s)^".*"\^\^([^"]*)$', r'(?s)^".*"@([^"]*)$'


@dataclass(frozen=True)
class Shape:
    kind: str
    prefix: str = ""

    def joins_raw(self, other: Shape) -> bool:
        """Whether equal terms are equal raw columns."""
        return self == other


@dataclass(frozen=True)
class Value:
    """``sure``: the column is never NULL, so no test of it is needed."""

    col: Column
    shape: Shape
    sure: bool = False

    @property
    def kind(self) -> str:
        return self.shape.kind


def shape_of(dtype: str) -> Shape:
    """The shape of a native column of this Spark type."""
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return Shape("int")
    if dtype.startswith("decimal"):
        return Shape("dec")
    if dtype in ("float", "double"):
        return Shape("dbl")
    if dtype == "boolean":
        return Shape("bool")
    if dtype in ("timestamp", "timestamp_ntz", "date"):
        return Shape("time")
    if dtype == "string":
        return Shape("str")
    raise ValueError(f"a column of {dtype} holds no term")


def constant(term: Term) -> Value:
    """A term as a typed literal column."""
    if isinstance(term, Iri):
        return Value(F.lit(term.value), Shape("iri"))
    if isinstance(term, Literal) and not term.lang:
        lex = term.lexical
        try:
            if term.datatype == XSD + "integer":
                n = int(lex)
                return Value(F.lit(n).cast("bigint" if abs(n) < 2**63 else "decimal(38,0)"), Shape("int"))
            if term.datatype == XSD + "decimal":
                return Value(F.lit(lex).cast("decimal(38,18)"), Shape("dec"))
            if term.datatype in (XSD + "double", XSD + "float"):
                return Value(F.lit(float(lex)), Shape("dbl"))
        except ValueError:
            return Value(F.lit(encode(term)), Shape("any"))
        if term.datatype == XSD + "boolean":
            return Value(F.lit(lex in ("true", "1")), Shape("bool"))
        if term.datatype == XSD + "dateTime":
            return Value(F.try_to_timestamp(F.lit(lex)).cast("timestamp_ntz"), Shape("time"))
        if term.datatype == XSD + "string":
            return Value(F.lit(lex), Shape("str"))
    return Value(F.lit(encode(term)), Shape("any"))


def double_text(c: Column) -> Column:
    return F.when(c == F.floor(c), F.when(F.abs(c) < 1e15, F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0")))).otherwise(c.cast("string"))


def _text(v: Value) -> Column:
    """A native value's lexical form."""
    if v.kind == "time":
        return F.regexp_replace(v.col.cast("timestamp_ntz").cast("string"), " ", "T")
    if v.kind == "dbl":
        return F.coalesce(double_text(v.col.cast("double")), v.col.cast("string"))
    if v.kind == "dec":
        return F.regexp_replace(v.col.cast("string"), r"(\.\d*?)0+$|\.$", "$1")
    return v.col.cast("string")


def generic(v: Value) -> Column:
    """Any value as canonical text."""
    if v.kind == "key":
        return F.concat(F.lit(v.shape.prefix), v.col.cast("string"))
    if v.kind in ("any", "iri"):
        return v.col
    if v.kind == "int":
        return v.col.cast("string")
    if v.kind == "str":
        return F.concat(F.lit('"'), v.col, F.lit('"'))
    return F.concat(F.lit('"'), _text(v), F.lit('"^^' + DATATYPES[v.kind]))


def to(v: Value, shape: Shape) -> Column:
    """The value in another shape that can hold it."""
    if v.shape == shape:
        return v.col
    if shape.kind == "any" or shape.kind == "iri":
        return generic(v)
    if shape.kind == "dbl" and v.kind in NUMERIC:
        return v.col.cast("double")
    if shape.kind == "dec" and v.kind == "int":
        return v.col.cast("decimal(38,18)")
    raise ValueError(f"{v.kind} isn't {shape.kind}")


def common(a: Shape, b: Shape) -> Shape:
    """A shape for the terms of both, with no change of a term."""
    if a == b:
        return a
    if {a.kind, b.kind} <= {"key", "iri"}:
        return Shape("iri")
    return Shape("any")


def wider(a: Shape, b: Shape) -> Shape:
    """A shape for the values of both, numbers promoted."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        return Shape(NUMERIC[max(NUMERIC.index(a.kind), NUMERIC.index(b.kind))])
    return common(a, b)


def lexical(v: Value) -> Column:
    """STR(): the IRI, or the literal's lexical form; NULL for a blank node."""
    if v.kind == "key":
        return generic(v)
    if v.kind != "any":
        return _text(v)
    c = v.col
    return F.when(c.startswith('"'), F.regexp_extract(c, _LEX, 1)).when(~c.startswith("_:"), c)


def number(v: Value) -> Value:
    """As a number; NULL if it isn't one."""
    if v.kind in NUMERIC:
        return v
    if v.kind == "any":
        c = v.col
        typed = F.regexp_extract(c, _TYPE, 1)
        return Value(F.when(c.rlike(r"^-?\d+$"), c.try_cast("double")).when(typed.startswith(XSD) & typed.rlike(_NUMBER_TAIL), F.regexp_extract(c, _LEX, 1).try_cast("double")), Shape("dbl"))
    return Value(F.lit(None).cast("double"), Shape("dbl"))


def text(v: Value) -> Column:
    """A string literal's text; NULL for other terms."""
    if v.kind == "str":
        return v.col
    if v.kind == "any":
        typed = F.regexp_extract(v.col, _TYPE, 1)
        plain = (typed == "") & (F.regexp_extract(v.col, _LANG, 1) == "")
        return F.when(v.col.startswith('"') & (plain | (typed == XSD + "string")), F.regexp_extract(v.col, _LEX, 1))
    return F.lit(None).cast("string")


def moment(v: Value) -> Column:
    """As a timestamp without zone; NULL if it isn't one."""
    if v.kind == "time":
        return v.col.cast("timestamp_ntz")
    if v.kind == "any":
        return F.when(F.regexp_extract(v.col, _TYPE, 1) == XSD + "dateTime", F.try_to_timestamp(F.regexp_extract(v.col, _LEX, 1)).cast("timestamp_ntz"))
    return F.lit(None).cast("timestamp_ntz")


def truth(v: Value) -> Column:
    """The effective boolean value."""
    if v.kind == "bool":
        return v.col
    if v.kind in NUMERIC:
        zero = v.col == 0
        return ~(zero | F.isnan(v.col)) if v.kind == "dbl" else ~zero
    if v.kind == "str":
        return v.col != ""
    if v.kind == "any":
        n, s = number(v).col, text(v)
        boolean = F.regexp_extract(v.col, _TYPE, 1) == XSD + "boolean"
        return F.when(boolean, F.regexp_extract(v.col, _LEX, 1).isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(s.isNotNull(), s != "")
    return F.lit(None).cast("boolean")


def rank(v: Value) -> list[Column]:
    """Sort columns: unbound, blank nodes, IRIs, then literals by value."""
    if v.kind != "any":
        return [generic(v) if v.kind == "key" and not v.shape.prefix else v.col]
    c = v.col
    order = F.when(c.isNull(), 0).when(c.startswith("_:"), 1).when(c.rlike("^[A-Za-z]"), 2).otherwise(3)
    return [order, number(v).col, lexical(v), c]


def datatype(v: Value) -> Column:
    if v.kind in DATATYPES:
        return F.when(v.col.isNotNull(), F.lit(DATATYPES[v.kind]))
    if v.kind == "any":
        c = v.col
        typed = F.regexp_extract(c, _TYPE, 1)
        return (
            F.when(c.rlike(r"^-?\d"), F.lit(XSD + "integer"))
            .when(c.startswith("<"), F.lit(RDF + "XMLLiteral"))
            .when(c.startswith('"') & (typed != ""), typed)
            .when(c.startswith('"') & (F.regexp_extract(c, _LANG, 1) != ""), F.lit(RDF + "langString"))
            .when(c.startswith('"'), F.lit(XSD + "string"))
        )
    return F.lit(None).cast("string")


def language(v: Value) -> Column:
    if v.kind == "any":
        return F.when(v.col.rlike('^["<0-9-]'), F.regexp_extract(v.col, _LANG, 1))
    return F.when(v.col.isNotNull(), F.lit("")) if v.kind in DATATYPES else F.lit(None).cast("string")


def renamed(v: Value, col: Column) -> Value:
    return replace(v, col=col)
