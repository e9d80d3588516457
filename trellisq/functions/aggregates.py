"""SPARQL aggregates as Spark aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Expr
from . import values as V
from .scalar import DBL, INT, STR, Scope, compile_expr
from .values import NUMERIC, Shape, Value


def _least(v: Value, smallest: bool) -> Value:
    pick = F.min if smallest else F.max
    if v.kind != "any":
        return Value(pick(v.col), v.shape)
    keys = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(V.rank(v))], v.col.alias("term"))
    return Value(pick(F.when(v.col.isNotNull(), keys))["term"], v.shape)


def _total(v: Value, once: bool) -> tuple[Column, Shape]:
    if v.kind == "any":
        n, add = V.number(v).col, F.sum_distinct if once else F.sum
        whole = F.when(v.col.rlike(r"^-?\d+$"), v.col.try_cast("bigint"))
        odd = F.count(F.when(n.isNotNull() & whole.isNull(), 1))
        summed = F.coalesce(add(n), F.lit(0.0))
        text = F.when(odd == 0, _whole_sum(whole, once).cast("string")).otherwise(F.concat(F.lit('"'), summed.cast("string"), F.lit('"^^' + V.DATATYPES["dbl"])))
        return text, Shape("any")
    add = F.sum_distinct if once else F.sum
    if v.kind not in NUMERIC:
        return F.lit(None).cast("bigint"), INT
    return (_whole_sum(v.col, once), INT) if v.kind == "int" else (F.coalesce(add(v.col), F.lit(0)), v.shape)


def _whole_sum(c: Column, once: bool) -> Column:
    """The sum of integers, 0 of none; NULL, which is SPARQL's error, if it is too large."""
    total = F.sum_distinct(c.cast("decimal(20,0)")).try_cast("bigint") if once else F.try_sum(c.cast("bigint"))
    return F.when(F.count(c) == 0, F.lit(0).cast("bigint")).otherwise(total)


def aggregate(expr: Expr, scope: Scope, row: list[Column]) -> Value:
    """The aggregate over a group; ``row`` is what COUNT(DISTINCT *) counts."""
    name, (once, separator) = expr.value, expr.extra
    if not expr.args:
        if not once:
            return Value(F.count(F.lit(1)), INT)
        # A struct of the row counts rows with unbound variables too.
        return Value(F.count_distinct(F.struct(*row) if row else F.lit(1)), INT)
    v = compile_expr(expr.args[0], scope)
    if name == "COUNT":
        return Value(F.count_distinct(v.col) if once else F.count(v.col), INT)
    if name == "SUM":
        col, shape = _total(v, once)
        return Value(col, shape)
    if name == "AVG":
        n = V.number(v).col.cast("double")
        return Value(F.coalesce(F.avg(n) if not once else F.sum_distinct(n) / F.count_distinct(n), F.lit(0.0)), DBL)
    if name in ("MIN", "SAMPLE"):
        return _least(v, True)
    if name == "MAX":
        return _least(v, False)
    # The texts of a group are one value in the end, so one task holds them.
    texts = (F.collect_set if once else F.collect_list)(V.lexical(v))
    return Value(F.array_join(F.array_sort(texts), separator), STR)
