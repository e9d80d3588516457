"""The SPARQL algebra that queries are parsed to."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.terms import Term, Var

Node = Term | Var


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node
    o: Node


@dataclass(frozen=True)
class Path:
    """A property path: kind is iri, inverse, sequence, alternative, optional,
    plus, star or negated."""

    kind: str
    parts: tuple = ()
    iri: str = ""


@dataclass(frozen=True)
class Expr:
    """An expression: op, its operands, and a value for leaves."""

    op: str
    args: tuple = ()
    value: object = None
    extra: object = None


@dataclass
class Plan:
    pass


@dataclass
class Bgp(Plan):
    triples: list[Triple] = field(default_factory=list)


@dataclass
class PathPattern(Plan):
    s: Node
    path: Path
    o: Node


@dataclass
class Join(Plan):
    left: Plan
    right: Plan


@dataclass
class LeftJoin(Plan):
    left: Plan
    right: Plan
    conditions: list[Expr]


@dataclass
class Union(Plan):
    left: Plan
    right: Plan


@dataclass
class Minus(Plan):
    left: Plan
    right: Plan


@dataclass
class Filter(Plan):
    conditions: list[Expr]
    child: Plan


@dataclass
class Extend(Plan):
    child: Plan
    var: str
    expr: Expr


@dataclass
class Values(Plan):
    names: list[str]
    rows: list[list[Term | None]]


@dataclass
class Group(Plan):
    """keys: (variable, expression); aggregates: (variable, aggregate expression)."""

    child: Plan
    keys: list[tuple[str, Expr]]
    aggregates: list[tuple[str, Expr]]


@dataclass
class Project(Plan):
    child: Plan
    names: list[str]


@dataclass
class Distinct(Plan):
    child: Plan


@dataclass
class OrderBy(Plan):
    child: Plan
    keys: list[tuple[Expr, bool]]


@dataclass
class Slice(Plan):
    child: Plan
    offset: int
    limit: int | None


def visible(plan: Plan) -> list[str]:
    """Names of the variables that a plan can bind, in order of appearance."""

    def of(*nodes: object) -> list[str]:
        return [n.name for n in nodes if isinstance(n, Var)]

    if isinstance(plan, Bgp):
        found = [n for t in plan.triples for n in of(t.s, t.p, t.o)]
    elif isinstance(plan, PathPattern):
        found = of(plan.s, plan.o)
    elif isinstance(plan, (Join, LeftJoin, Union)):
        found = visible(plan.left) + visible(plan.right)
    elif isinstance(plan, Minus):
        found = visible(plan.left)
    elif isinstance(plan, Extend):
        found = [*visible(plan.child), plan.var]
    elif isinstance(plan, Values):
        found = plan.names
    elif isinstance(plan, Group):
        found = [n for n, _ in plan.keys] + [n for n, _ in plan.aggregates]
    elif isinstance(plan, Project):
        found = plan.names
    else:
        found = visible(plan.child)
    return list(dict.fromkeys(found))


def names_in(expr: Expr) -> set[str]:
    """Variables that an expression mentions, those inside EXISTS included."""
    if expr.op == "var":
        return {expr.value}
    if expr.op == "exists":
        return set(visible(expr.value))
    return set().union(*(names_in(a) for a in expr.args if isinstance(a, Expr)))
