"""Expressions as columns. An error in SPARQL's sense is NULL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Expr
from . import values as V
from .terms import XSD
from .values import NUMERIC, Shape, Value

ANY, INT, DBL, STR, BOOL, TIME, IRI = (Shape(k) for k in ("any", "int", "dbl", "str", "bool", "time", "iri"))


class Scope(Protocol):
    """What an expression sees: variables, and EXISTS patterns as columns."""

    def value(self, name: str) -> Value: ...
    def exists(self, expr: Expr) -> Column: ...


def unbound() -> Value:
    return Value(F.lit(None).cast("string"), ANY)


def condition(expr: Expr, scope: Scope) -> Column:
    return V.truth(compile_expr(expr, scope))


def compile_expr(expr: Expr, scope: Scope) -> Value:
    op = expr.op
    if op == "var":
        return scope.value(expr.value)
    if op == "term":
        return V.constant(expr.value)
    if op == "exists":
        return Value(scope.exists(expr), BOOL)
    if op == "call" and expr.value == "BOUND":
        return Value(scope.value(expr.args[0].value).col.isNotNull(), BOOL)
    args = [compile_expr(a, scope) for a in expr.args]
    if op == "not":
        return Value(~V.truth(args[0]), BOOL)
    if op in ("and", "or"):
        a, b = map(V.truth, args)
        return Value(a & b if op == "and" else a | b, BOOL)
    if op == "compare":
        return Value(compare(expr.value, *args), BOOL)
    if op == "in":
        tests = [compare("=", args[0], b) for b in args[1:]]
        return Value(reduce(lambda a, b: a | b, tests, F.lit(False)), BOOL)
    if op == "math":
        return math(expr.value, *args)
    if op == "cast":
        return cast(expr.value, args)
    return call(expr.value, args)


def compare(sign: str, a: Value, b: Value) -> Column:
    """= and != by term or value; < and others for literals of one kind."""
    if a.kind in NUMERIC and b.kind in NUMERIC:
        wide = V.wider(a.shape, b.shape)
        return _signed(sign, V.to(a, wide), V.to(b, wide))
    if "time" in (a.kind, b.kind):
        return _signed(sign, V.moment(a), V.moment(b))
    if a.kind == b.kind and a.kind in ("str", "bool", "iri") or a.shape == b.shape and a.kind == "key":
        return _signed(sign, a.col, b.col)
    if "any" in (a.kind, b.kind):
        na, nb, sa, sb, ma, mb = V.number(a).col, V.number(b).col, V.text(a), V.text(b), V.moment(a), V.moment(b)
        by_value = [(x.isNotNull() & y.isNotNull(), _signed(sign, x, y)) for x, y in ((na, nb), (sa, sb), (ma, mb))]
        found = reduce(lambda c, w: c.when(*w), by_value[1:], F.when(*by_value[0]))
        return found.otherwise(_signed(sign, V.generic(a), V.generic(b))) if sign in ("=", "!=") else found
    if {a.kind, b.kind} <= {"key", "iri"}:
        return _signed(sign, V.generic(a), V.generic(b))
    if {"key", "iri"} & {a.kind, b.kind} and sign in ("=", "!="):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(sign == "!="))
    return F.lit(None).cast("boolean")


def _signed(sign: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


def math(sign: str, a: Value, b: Value) -> Value:
    a, b = V.number(a), V.number(b)
    shape = V.wider(a.shape, b.shape)
    x, y = V.to(a, shape), V.to(b, shape)
    if sign == "/" and shape.kind == "int":
        return Value(F.try_divide(x.cast("decimal(20,0)"), y.cast("decimal(20,0)")), Shape("dec"))
    return Value({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[sign](x, y), shape)


def cast(iri: str, args: list[Value]) -> Value:
    """A cast to an XSD type."""
    if len(args) != 1 or not iri.startswith(XSD):
        raise ValueError(f"no function {iri}")
    v, name = args[0], iri[len(XSD) :]
    lex = V.lexical(v)
    if name == "string":
        return Value(lex, STR)
    if name == "boolean":
        return v if v.kind == "bool" else Value(F.when(F.lower(lex).isin("true", "1"), True).when(F.lower(lex).isin("false", "0"), False), BOOL) if v.kind not in NUMERIC else Value(V.truth(v), BOOL)
    if name in ("integer", "int", "long"):
        if v.kind in NUMERIC:
            return Value(v.col.try_cast("bigint"), INT)
        if v.kind == "bool":
            return Value(v.col.cast("bigint"), INT)
        return Value(F.when(lex.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(lex).try_cast("bigint")).otherwise(F.when(V.number(v).col.isNotNull(), V.number(v).col.try_cast("bigint"))), INT)
    if name == "decimal":
        return Value((v.col if v.kind in NUMERIC else lex).try_cast("decimal(38,18)"), Shape("dec"))
    if name in ("double", "float"):
        return Value((v.col if v.kind in NUMERIC else lex).try_cast("double"), DBL)
    if name in ("dateTime", "date"):
        return v if v.kind == "time" else Value(F.try_to_timestamp(lex).cast("timestamp_ntz"), TIME)
    raise ValueError(f"no cast to {iri}")


def _string(f: Callable[..., Column], shape: Shape = STR) -> Callable[..., Value]:
    """A function of string literals; a language tag of the first is dropped."""
    return lambda *args: Value(f(*(_literal_text(a) for a in args)), shape)


def _literal_text(v: Value) -> Column:
    if v.kind == "any":
        typed = F.regexp_extract(v.col, r'(?s)^".*"\^\^([^"]*)$', 1)
        return F.when(v.col.startswith('"') & ((typed == "") | (typed == XSD + "string")), V.lexical(v))
    return V.text(v)


def _number(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    def of(v: Value) -> Value:
        n = V.number(v)
        found = f(n.col)
        return Value(found.cast("bigint") if n.kind == "int" else found.cast("double") if n.kind == "dbl" else found, n.shape)

    return of


def _part(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return lambda v: Value(f(V.moment(v)).cast("bigint"), INT)


def _if(test: Value, a: Value, b: Value) -> Value:
    shape = V.common(a.shape, b.shape)
    t = V.truth(test)
    return Value(F.when(t, V.to(a, shape)).when(~t, V.to(b, shape)), shape)


def _coalesce(*args: Value) -> Value:
    shape = reduce(V.common, (a.shape for a in args))
    return Value(F.coalesce(*(V.to(a, shape) for a in args)), shape)


def _before(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.when(s.isNotNull() & sep.isNotNull(), F.lit("")))


def _after(s: Column, sep: Column) -> Column:
    at = F.position(sep, s)
    return F.when(at > 0, F.substring(s, at + F.length(sep), F.length(s))).otherwise(F.when(s.isNotNull() & sep.isNotNull(), F.lit("")))


def _flagged(pattern: Value, flags: Value | None) -> Column:
    """The pattern with its flags (i, s, m, x) in front."""
    p = V.text(pattern)
    return p if flags is None else F.concat(F.when(V.text(flags) == "", F.lit("")).otherwise(F.concat(F.lit("(?"), V.text(flags), F.lit(")"))), p)


def _substr(s: Value, start: Value, length: Value | None = None) -> Value:
    text, at = _literal_text(s), V.number(start).col.cast("int")
    return Value(F.substring(text, at, V.number(length).col.cast("int") if length else F.length(text)), STR)


def _kind_test(native: set[str], pattern: str) -> Callable[[Value], Value]:
    def of(v: Value) -> Value:
        found = v.col.rlike(pattern) if v.kind == "any" else F.when(v.col.isNotNull(), F.lit(v.kind in native))
        return Value(found, BOOL)

    return of


def _numeric(v: Value) -> Value:
    return Value(F.when(v.col.isNotNull(), V.number(v).col.isNotNull()), BOOL)


def _hash(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    return _string(f)


def _lang_matches(tag: Value, wanted: Value) -> Value:
    t, w = F.lower(V.text(tag)), F.lower(V.text(wanted))
    return Value(F.when(w == "*", t != "").otherwise((t == w) | t.startswith(F.concat(w, F.lit("-")))), BOOL)


def _same_term(a: Value, b: Value) -> Value:
    return Value(V.generic(a) == V.generic(b), BOOL)


def _now() -> Value:
    return Value(F.current_timestamp().cast("timestamp_ntz"), TIME)


_LITERALS = {"int", "dec", "dbl", "str", "bool", "time"}
CALLS: dict[str, Callable[..., Value]] = {
    "STR": lambda v: Value(V.lexical(v), STR),
    "LANG": lambda v: Value(V.language(v), STR),
    "LANGMATCHES": _lang_matches,
    "DATATYPE": lambda v: Value(V.datatype(v), IRI),
    "IRI": lambda v: Value(V.lexical(v), IRI),
    "URI": lambda v: Value(V.lexical(v), IRI),
    "BNODE": lambda *v: Value(F.concat(F.lit("_:"), V.text(v[0]) if v else F.uuid()), ANY),
    "STRDT": lambda s, t: Value(F.when(V.generic(t) == XSD + "string", V.generic(s)).otherwise(F.concat(F.lit('"'), V.text(s), F.lit('"^^'), V.generic(t))), ANY),
    "STRLANG": lambda s, t: Value(F.concat(F.lit('"'), V.text(s), F.lit('"@'), F.lower(V.text(t))), ANY),
    "ISIRI": _kind_test({"key", "iri"}, "^[A-Za-z]"),
    "ISURI": _kind_test({"key", "iri"}, "^[A-Za-z]"),
    "ISBLANK": _kind_test(set(), "^_:"),
    "ISLITERAL": _kind_test(_LITERALS, '^["<0-9-]'),
    "ISNUMERIC": _numeric,
    "SAMETERM": _same_term,
    "IF": _if,
    "COALESCE": _coalesce,
    "STRLEN": _string(lambda s: F.length(s).cast("bigint"), INT),
    "SUBSTR": _substr,
    "UCASE": _string(F.upper),
    "LCASE": _string(F.lower),
    "STRSTARTS": _string(lambda a, b: F.startswith(a, b), BOOL),
    "STRENDS": _string(lambda a, b: F.endswith(a, b), BOOL),
    "CONTAINS": _string(lambda a, b: F.contains(a, b), BOOL),
    "STRBEFORE": _string(_before),
    "STRAFTER": _string(_after),
    "ENCODE_FOR_URI": _string(lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(s), r"\+", "%20"), r"\*", "%2A"), "%7E", "~")),
    "CONCAT": _string(lambda *s: F.concat(*s)),
    "REGEX": lambda s, p, f=None: Value(F.regexp_like(_literal_text(s), _flagged(p, f)), BOOL),
    "REPLACE": lambda s, p, r, f=None: Value(F.regexp_replace(_literal_text(s), _flagged(p, f), V.text(r)), STR),
    "ABS": _number(F.abs),
    "ROUND": _number(lambda n: F.floor(n + F.lit(0.5))),
    "CEIL": _number(F.ceil),
    "FLOOR": _number(F.floor),
    "RAND": lambda: Value(F.rand(), DBL),
    "NOW": _now,
    "YEAR": _part(F.year),
    "MONTH": _part(F.month),
    "DAY": _part(F.day),
    "HOURS": _part(F.hour),
    "MINUTES": _part(F.minute),
    "SECONDS": lambda v: Value(F.expr("0.0").cast("decimal(8,6)") + F.date_part(F.lit("SECOND"), V.moment(v)), Shape("dec")),
    "TIMEZONE": lambda v: unbound(),
    "TZ": lambda v: Value(F.when(V.moment(v).isNotNull(), F.lit("")), STR),
    "MD5": _hash(F.md5),
    "SHA1": _hash(F.sha1),
    "SHA256": _hash(lambda s: F.sha2(s, 256)),
    "SHA384": _hash(lambda s: F.sha2(s, 384)),
    "SHA512": _hash(lambda s: F.sha2(s, 512)),
    "UUID": lambda: Value(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI),
    "STRUUID": lambda: Value(F.uuid(), STR),
}


def call(name: str, args: list[Value]) -> Value:
    try:
        return CALLS[name](*args)
    except TypeError as e:
        raise ValueError(f"{name} doesn't take {len(args)} arguments") from e


