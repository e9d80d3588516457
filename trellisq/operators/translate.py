"""The algebra as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.aggregates import aggregate
from ..functions.scalar import compile_expr, condition
from ..functions.terms import Term, encode
from ..functions.values import Shape, Value
from ..plans import algebra as A
from ..plans import rewrite
from ..plans.algebra import Expr
from ..sources.store_sources import Source
from . import paths
from . import relation as R
from .relation import Info, Relation, column


class Scope:
    """A relation's columns for expressions; EXISTS patterns are marker columns."""

    def __init__(self, relation: Relation, markers: dict[int, str] | None = None):
        self.relation, self.markers = relation, markers or {}

    def value(self, name: str) -> Value:
        return self.relation.value(name)

    def exists(self, expr: Expr) -> Column:
        if id(expr) not in self.markers:
            raise ValueError("EXISTS is not offered at this place")
        return F.col(self.markers[id(expr)])


def _patterns(expr: Expr) -> list[Expr]:
    """The EXISTS parts of an expression."""
    if expr.op == "exists":
        return [expr]
    return [x for a in expr.args if isinstance(a, Expr) for x in _patterns(a)]


def _conjuncts(expr: Expr) -> list[Expr]:
    return [x for a in expr.args for x in _conjuncts(a)] if expr.op == "and" else [expr]


class Translator:
    def __init__(self, source: Source):
        self.source, self.spark, self.marks = source, source.spark, 0

    def run(self, plan: A.Plan) -> Relation:
        return getattr(self, f"_{type(plan).__name__.lower()}")(plan)

    def _bgp(self, plan: A.Bgp) -> Relation:
        if not plan.triples:
            return R.unit(self.spark)
        if hasattr(self.source, "bgp"):  # the source joins its patterns itself
            return self.source.bgp(plan.triples)
        units = rewrite.ordered(rewrite.stars(plan.triples, self.source.star_key))
        scans = [self.source.star(u) if self.source.star_key(u[0]) is not None else self.source.scan(u[0]) for u in units]
        return reduce(R.join, scans)

    def _pathpattern(self, plan: A.PathPattern) -> Relation:
        return paths.match(self.source, plan.s, plan.path, plan.o)

    def _join(self, plan: A.Join) -> Relation:
        left, right = plan.left, plan.right
        if isinstance(left, A.Bgp) and isinstance(right, A.Bgp):  # one pattern, one order
            return self._bgp(A.Bgp([*left.triples, *right.triples]))
        return R.join(self.run(left), self.run(right))

    def _leftjoin(self, plan: A.LeftJoin) -> Relation:
        left = self.run(plan.left)
        if any(_patterns(c) for c in plan.conditions):
            # The pattern inside sees the pairs: mark them, then keep who matches.
            matched = self._filtered(R.join(R.tagged(left), self.run(plan.right)), plan.conditions)
            found = R.union(matched, R.anti(left, matched))
            return found.select([n for n in found.vars if not n.startswith(".own_")])
        test = (lambda both: self._all(plan.conditions, both)) if plan.conditions else None
        return R.left_join(left, self.run(plan.right), test)

    def _all(self, conditions: list[Expr], relation: Relation) -> Column:
        return reduce(lambda a, b: a & b, [condition(c, Scope(relation)) for c in conditions])

    def _union(self, plan: A.Union) -> Relation:
        return R.union(self.run(plan.left), self.run(plan.right))

    def _minus(self, plan: A.Minus) -> Relation:
        return R.minus(self.run(plan.left), self.run(plan.right))

    def _filter(self, plan: A.Filter) -> Relation:
        return self._filtered(self.run(plan.child), plan.conditions)

    def _filtered(self, relation: Relation, conditions: list[Expr]) -> Relation:
        for part in [c for whole in conditions for c in _conjuncts(whole)]:
            negated = part.op == "not" and part.args[0].op == "exists"
            if part.op == "exists" or negated:
                right, test = self._inside(part.args[0] if negated else part, relation)
                relation = R.exists(relation, right, test, negated)
                continue
            marked, markers = relation, {}
            for pattern in _patterns(part):
                name = f"m_{self.marks}"
                self.marks += 1
                right, test = self._inside(pattern, relation)
                marked = R.marked(marked, right, test, name)
                markers[id(pattern)] = name
            kept = marked.where(condition(part, Scope(marked, markers)))
            relation = Relation(kept.df.drop(*markers.values()), kept.vars) if markers else kept
        return relation

    def _inside(self, expr: Expr, outer: Relation) -> tuple[Relation, object]:
        """An EXISTS pattern's solutions, and the filters that need outer variables."""
        plan, late = expr.value, []
        if isinstance(plan, A.Filter):
            inner = set(A.visible(plan.child))
            parts = [c for whole in plan.conditions for c in _conjuncts(whole)]
            late = [c for c in parts if not A.names_in(c) <= inner and A.names_in(c) & set(outer.vars)]
            early = [c for c in parts if c not in late]
            plan = A.Filter(early, plan.child) if early else plan.child
        return self.run(plan), (lambda both: self._all(late, both)) if late else None

    def _extend(self, plan: A.Extend) -> Relation:
        child = self.run(plan.child)
        value = compile_expr(plan.expr, Scope(child))
        sure = plan.expr.op == "term" or plan.expr.op == "var" and plan.expr.value in child.vars and child.vars[plan.expr.value].certain
        df = child.df.select("*", value.col.alias(column(plan.var)))
        return Relation(df, {**child.vars, plan.var: Info(value.shape, sure)})

    def _values(self, plan: A.Values) -> Relation:
        infos, columns = {}, []
        for i, name in enumerate(plan.names):
            terms = [row[i] for row in plan.rows]
            shape, cells = _inline(terms)
            infos[name] = Info(shape, None not in terms)
            columns.append(cells)
        if not plan.rows:
            return R.empty(self.spark, plan.names)
        rows = [F.struct(*[columns[i][r].alias(column(n)) for i, n in enumerate(plan.names)]) for r in range(len(plan.rows))]
        df = self.spark.range(1).select(F.inline(F.array(*rows))) if plan.names else self.spark.range(len(plan.rows)).select()
        return Relation(df, infos)

    def _group(self, plan: A.Group) -> Relation:
        child = self.run(plan.child)
        keyed, infos = child, {}
        for name, expr in plan.keys:
            value = compile_expr(expr, Scope(child))
            sure = expr.op == "var" and name in child.vars and child.vars[name].certain
            infos[name] = Info(value.shape, sure)
            if expr.op != "var" or name not in child.vars:
                keyed = Relation(keyed.df.select("*", value.col.alias(column(name))), {**keyed.vars, name: infos[name]})
        row = [F.col(column(n)) for n in child.vars]
        found = {name: aggregate(expr, Scope(keyed), row) for name, expr in plan.aggregates}
        keys = [column(n) for n, _ in plan.keys]
        if found:
            df = keyed.df.groupBy(*keys).agg(*[v.col.alias(column(n)) for n, v in found.items()])
        else:
            df = keyed.df.select(*keys).distinct()
        infos |= {n: Info(v.shape, e.value == "COUNT") for (n, v), (_, e) in zip(found.items(), plan.aggregates, strict=True)}
        return Relation(df, infos)

    def _project(self, plan: A.Project) -> Relation:
        if isinstance(plan.child, A.OrderBy):  # sort keys may be dropped by the projection
            child = self._sorted(plan.child)
            return child.select(plan.names)
        return self.run(plan.child).select(plan.names)

    def _distinct(self, plan: A.Distinct) -> Relation:
        if isinstance(plan.child, A.Project) and isinstance(plan.child.child, A.OrderBy):
            # Rows are made different first, then sorted by what is projected.
            order = plan.child.child
            found = self._project(A.Project(order.child, plan.child.names)).distinct()
            return self._by(found, order.keys)
        return self.run(plan.child).distinct()

    def _orderby(self, plan: A.OrderBy) -> Relation:
        return self._sorted(plan)

    def _sorted(self, plan: A.OrderBy) -> Relation:
        return self._by(self.run(plan.child), plan.keys)

    def _by(self, relation: Relation, keys: list[tuple[Expr, bool]]) -> Relation:
        columns = []
        for expr, down in keys:
            for c in V.rank(compile_expr(expr, Scope(relation))):
                columns.append(c.desc_nulls_last() if down else c.asc_nulls_first())
        return Relation(relation.df.orderBy(*columns), relation.vars)

    def _slice(self, plan: A.Slice) -> Relation:
        child = self.run(plan.child)
        df = child.df.offset(plan.offset) if plan.offset else child.df
        return Relation(df if plan.limit is None else df.limit(plan.limit), child.vars)


def _inline(terms: list[Term | None]) -> tuple[Shape, list[Column]]:
    """Terms of a column of VALUES: native if all are of one kind."""
    held = [V.constant(t) for t in terms if t is not None]
    kinds = {v.kind for v in held}
    if len(kinds) == 1:
        shape = held[0].shape
        dtype = {"int": "bigint", "dec": "decimal(38,18)", "dbl": "double", "bool": "boolean", "time": "timestamp_ntz"}.get(shape.kind, "string")
        return shape, [(V.constant(t).col if t is not None else F.lit(None)).cast(dtype) for t in terms]
    return Shape("any"), [F.lit(None if t is None else encode(t)).cast("string") for t in terms]
