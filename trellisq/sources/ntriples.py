"""N-Triples to canonical triples, with built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import INTEGERS, XML_LITERAL, XSD

SUFFIXES = (".nt", ".ntriples")
_IRI, _BLANK = r"<([^<>\s]*)>", r"_:([\w](?:[\w.\-]*[\w\-])?)"
_LITERAL = r'("[^"\\]*+(?:\\.[^"\\]*+)*+)"(?:\^\^<([^<>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?'
LINE = rf"^\s*(?:{_IRI}|{_BLANK})\s*<([^<>\s]*)>\s*(?:{_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"
#: A line's groups, each behind a line end; the literal is last, the others hold no line end.
_GROUPS = "".join(f"\n${i}" for i in (1, 2, 3, 4, 5, 7, 8, 6))
# The escapes of the format.
ESCAPES = {r"\t": "\t", r"\b": "\b", r"\n": "\n", r"\r": "\r", r"\f": "\f", r"\"": '"', r"\'": "'"}


def unescape(c: Column) -> Column:
    """The text with its escapes undone: the backslash is set aside first, and
    numbered characters are rebuilt from their digits."""
    mark = "\ue000"
    out = F.replace(c, F.lit("\\\\"), F.lit(mark))
    out = reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), out)
    pieces = F.split(out, r"(?=\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})")

    def rebuilt(p: Column) -> Column:
        def char(digits: int) -> Column:
            code = F.conv(F.substring(p, 3, digits), 16, 10).cast("int")
            wide = F.lpad(F.hex(code), 8, "0")
            return F.concat(F.decode(F.unhex(wide), "UTF-32"), F.substring(p, F.lit(3 + digits), F.length(p)))

        return F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}"), char(4)).when(p.rlike(r"^\\U[0-9A-Fa-f]{8}"), char(8)).otherwise(p)

    has = out.contains("\\u") | out.contains("\\U")
    return F.replace(F.when(has, F.array_join(F.transform(pieces, rebuilt), "")).otherwise(out), F.lit(mark), F.lit("\\"))


def parse_lines(lines: DataFrame, column: str = "value", scope: str = "", literal_mode: str = "typed", on_error: str = "fail") -> DataFrame:
    """(s, p, o) of N-Triples lines; blank lines and comments are skipped.

    ``scope`` is put before blank labels. ``literal_mode='lexical'`` drops
    datatypes. A malformed line fails the job, or with ``on_error='skip'`` goes.
    """
    if literal_mode not in ("typed", "lexical") or on_error not in ("fail", "skip"):
        raise ValueError("literal_mode is typed or lexical, on_error fail or skip")
    line = F.col(column)
    kept = lines.where(~line.rlike(r"^\s*(#.*)?$"))

    # A generator's output is computed once a row, however often it is used above.
    groups = F.split(F.regexp_replace(line, LINE + "(?s:.*)", _GROUPS), "\n", 9)
    groups = F.when(line.contains("\\"), F.transform(groups, lambda x, i: F.when(i == 6, x).otherwise(unescape(x)))).otherwise(groups)
    kept = kept.select(line.alias("line"), F.explode(F.array(groups)).alias("groups"))
    line = F.col("line")

    def g(i: int) -> Column:
        return F.get("groups", F.lit((0, 1, 2, 3, 4, 5, 8, 6, 7)[i]))

    def node(iri: int, blank: int) -> Column:
        return F.when(g(blank) != "", F.concat(F.lit(f"_:{scope}"), g(blank))).otherwise(g(iri))

    lex, kind, lang = F.substring(g(6), F.lit(2), F.length(g(6))), g(7), F.lower(g(8))
    plain = F.concat(F.lit('"'), lex, F.lit('"'))
    literal = F.when(lang != "", F.concat(plain, F.lit("@"), lang))
    if literal_mode == "typed":
        digits = F.regexp_extract(lex, r"^[+]?(-?)0*(\d+)$", 2)
        sign = F.when(digits != "0", F.regexp_extract(lex, r"^[+]?(-?)0*(\d+)$", 1)).otherwise(F.lit(""))
        literal = (
            literal.when(kind.isin(*INTEGERS) & (digits != ""), F.concat(sign, digits))
            .when((kind == XML_LITERAL) & lex.startswith("<"), lex)
            .when((kind != "") & (kind != XSD + "string"), F.concat(plain, F.lit("^^"), kind))
        )
    obj = F.when(g(6) != "", literal.otherwise(plain)).otherwise(node(4, 5))
    # Only a line that holds a line end can look like groups without being any.
    good = (F.size("groups") == 9) & (~line.contains("\n") | line.rlike(LINE))
    if on_error == "skip":
        kept = kept.where(good)
        s = node(1, 2)
    else:
        s = F.when(good, node(1, 2)).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), line)).cast("string"))
    return kept.select(s.alias("s"), g(3).alias("p"), obj.alias("o"))


def lines(triples: DataFrame) -> DataFrame:
    """(value): the N-Triples lines of (s, p, o) in canonical text."""

    def escaped(c: Column) -> Column:
        return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")], c)

    def node(c: Column) -> Column:
        return F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))

    o = F.col("o")
    tail = F.substring_index(o, '"', -1)
    lexical = escaped(F.substring(o, F.lit(2), F.length(o) - F.length(tail) - 2))
    typed = F.when(tail.startswith("^^"), F.concat(F.lit("^^<"), F.substring(tail, F.lit(3), F.length(tail)), F.lit(">"))).otherwise(tail)

    def literal(lex: Column, kind: Column) -> Column:
        return F.concat(F.lit('"'), lex, F.lit('"'), kind)

    obj = (
        F.when(o.startswith('"'), literal(lexical, typed))
        .when(o.rlike(r"^-?\d"), literal(o, F.lit(f"^^<{XSD}integer>")))
        .when(o.startswith("<"), literal(escaped(o), F.lit(f"^^<{XML_LITERAL}>")))
        .otherwise(node(o))
    )
    return triples.select(F.concat_ws(" ", node(F.col("s")), node(F.col("p")), obj, F.lit(".")).alias("value"))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The triples of a file or folder ending in .nt or .ntriples (which may be
    compressed), as often as they stand there."""
    bare = path.removesuffix(".gz").removesuffix(".bz2")
    if not bare.endswith(SUFFIXES):
        raise ValueError(f"only {' and '.join(SUFFIXES)} files can be loaded, not {path}")
    return parse_lines(spark.read.text(path), **options)


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The set of triples that ``read`` gives."""
    return read(spark, path, **options).dropDuplicates(["s", "p", "o"])
