"""Solutions as DataFrames, and the joins of SPARQL on them.

A relation has one column a variable, named ``v_`` and the variable's name.
A variable is certain if no row leaves it unbound (NULL). Joins on certain
variables are plain equi-joins. Where a shared variable may be unbound, the
side is split into its bound and unbound rows, each joined on what it binds,
since NULL-tolerant equality would end in a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Shape, Value


def column(name: str) -> str:
    return f"v_{name.replace('.', '_')}" if name.startswith(".") else f"v_{name}"


@dataclass
class Info:
    shape: Shape
    certain: bool = True


@dataclass
class Relation:
    df: DataFrame
    vars: dict[str, Info]

    def value(self, name: str) -> Value:
        if name not in self.vars:
            return Value(F.lit(None).cast("string"), Shape("any"))
        return Value(F.col(column(name)), self.vars[name].shape)

    def select(self, names: list[str]) -> Relation:
        """Only these variables; one that isn't there is unbound."""
        found = {n: self.vars.get(n, Info(Shape("any"), False)) for n in names}
        return Relation(self.df.select(*[self.value(n).col.alias(column(n)) for n in names]), found)

    def where(self, condition: Column) -> Relation:
        return Relation(self.df.where(condition), self.vars)

    def shaped(self, shapes: dict[str, Shape]) -> Relation:
        """With these variables in these shapes."""
        changed = {n: s for n, s in shapes.items() if n in self.vars and self.vars[n].shape != s}
        if not changed:
            return self
        cols = [V.to(self.value(n), changed[n]).alias(column(n)) if n in changed else F.col(column(n)) for n in self.vars]
        return Relation(self.df.select(*cols), {n: Info(changed.get(n, i.shape), i.certain) for n, i in self.vars.items()})

    def distinct(self) -> Relation:
        return Relation(self.df.distinct(), self.vars)


@dataclass
class Named:
    """Values by variable, for conditions over two relations at once."""

    values: dict[str, Value]

    @property
    def vars(self) -> dict[str, Info]:
        return {n: Info(v.shape) for n, v in self.values.items()}

    def value(self, name: str) -> Value:
        return self.values.get(name, Value(F.lit(None).cast("string"), Shape("any")))


def unit(spark: SparkSession) -> Relation:
    """One solution that binds nothing."""
    return Relation(spark.range(1).select(), {})


def empty(spark: SparkSession, names: list[str]) -> Relation:
    df = spark.range(0).select(*[F.lit(None).cast("string").alias(column(n)) for n in names])
    return Relation(df, {n: Info(Shape("any")) for n in names})


def union(left: Relation, right: Relation) -> Relation:
    """Bag union; a variable of one side only is unbound in the other's rows."""
    names = list(dict.fromkeys([*left.vars, *right.vars]))
    shapes, infos = {}, {}
    for n in names:
        a, b = left.vars.get(n), right.vars.get(n)
        shapes[n] = V.common(a.shape, b.shape) if a and b else (a or b).shape
        infos[n] = Info(shapes[n], bool(a and b and a.certain and b.certain))
    sides = []
    for side in (left.shaped(shapes), right.shaped(shapes)):
        sides.append(side.df.select(*[F.col(column(n)) if n in side.vars else F.lit(None).alias(column(n)) for n in names]))
    return Relation(sides[0].unionByName(sides[1]), infos)


def aligned(left: Relation, right: Relation) -> tuple[Relation, Relation, list[str]]:
    """Both sides with their shared variables in one shape."""
    shared = [n for n in left.vars if n in right.vars]
    shapes = {n: V.common(left.vars[n].shape, right.vars[n].shape) for n in shared}
    return left.shaped(shapes), right.shaped(shapes), shared


def _renamed(right: Relation, shared: list[str]) -> DataFrame:
    return right.df.select(*[F.col(column(n)).alias(f"r_{column(n)}") if n in shared else F.col(column(n)) for n in right.vars])


def _equal(shared: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(column(n)) == F.col(f"r_{column(n)}") for n in shared])


def _split(side: Relation, name: str) -> tuple[Relation, Relation]:
    """Rows that bind the variable, and the others without it."""
    c = F.col(column(name))
    bound = Relation(side.df.where(c.isNotNull()), {**side.vars, name: Info(side.vars[name].shape)})
    rest = {n: i for n, i in side.vars.items() if n != name}
    return bound, Relation(side.df.where(c.isNull()).drop(column(name)), rest)


def _uncertain(left: Relation, right: Relation) -> tuple[str, bool] | None:
    """A shared variable that may be unbound, and whether on the left."""
    for n in left.vars:
        if n in right.vars and not (left.vars[n].certain and right.vars[n].certain):
            return n, not left.vars[n].certain
    return None


def join(left: Relation, right: Relation) -> Relation:
    """All compatible pairs."""
    left, right, shared = aligned(left, right)
    open_var = _uncertain(left, right)
    if open_var:
        name, on_left = open_var
        bound, rest = _split(left if on_left else right, name)
        if on_left:
            return _ordered(union(join(bound, right), join(rest, right)), left, right)
        return _ordered(union(join(left, bound), join(left, rest)), left, right)
    infos = {**right.vars, **left.vars}
    if not shared:
        return Relation(left.df.crossJoin(right.df), infos)
    df = left.df.join(_renamed(right, shared), _equal(shared), "inner")
    names = [*left.vars, *(n for n in right.vars if n not in left.vars)]
    return Relation(df.select(*[column(n) for n in names]), {n: infos[n] for n in names})


def _ordered(found: Relation, left: Relation, right: Relation) -> Relation:
    names = [*left.vars, *(n for n in right.vars if n not in left.vars)]
    infos = {n: Info(found.vars[n].shape, left.vars.get(n, Info(Shape("any"), False)).certain or right.vars.get(n, Info(Shape("any"), False)).certain) for n in names}
    return Relation(found.df.select(*[column(n) for n in names]), infos)


def left_join(left: Relation, right: Relation, condition: Callable[[Relation], Column] | None) -> Relation:
    """Every left row with its matches, or alone. ``condition`` sees both sides."""
    left, right, shared = aligned(left, right)
    extra = {n: Info(i.shape, False) for n, i in right.vars.items() if n not in left.vars}
    if not _uncertain(left, right) and shared:
        both = Relation(left.df, {**right.vars, **left.vars})
        on = _equal(shared)
        if condition is not None:
            on = on & condition(both)
        df = left.df.join(_renamed(right, shared), on, "left")
        return Relation(df.select(*[column(n) for n in [*left.vars, *extra]]), {**left.vars, **extra})
    pairs = join(tagged(left), right)
    if condition is not None:
        pairs = pairs.where(condition(pairs))
    found = union(pairs, anti(left, pairs))
    return Relation(found.df.select(*[column(n) for n in [*left.vars, *extra]]), {n: Info(found.vars[n].shape, found.vars[n].certain) for n in [*left.vars, *extra]})


def _own(name: str) -> str:
    return f".own_{name}"


def tagged(left: Relation) -> Relation:
    """With a copy of each variable that may be unbound: a join may bind the
    variable, and the copy still tells the left row."""
    open_vars = [n for n, i in left.vars.items() if not i.certain]
    copies = [left.value(n).col.alias(column(_own(n))) for n in open_vars]
    return Relation(left.df.select("*", *copies), {**left.vars, **{_own(n): Info(left.vars[n].shape, False) for n in open_vars}})


def _same_rows(left: Relation, pairs: Relation) -> tuple[DataFrame, Column]:
    """The distinct left parts of ``pairs``, and NULL-safe equality with left rows."""
    left_names = list(left.vars)
    told = {n: _own(n) if _own(n) in pairs.vars else n for n in left_names}
    pairs = pairs.shaped({told[n]: left.vars[n].shape for n in left_names})
    keys = Relation(pairs.df.select(*[F.col(column(told[n])).alias(column(n)) for n in left_names]).distinct(), left.vars)
    on = reduce(lambda a, b: a & b, [F.col(column(n)).eqNullSafe(F.col(f"r_{column(n)}")) for n in left_names], F.lit(True))
    return _renamed(keys, left_names), on


def anti(left: Relation, pairs: Relation) -> Relation:
    """Left rows that no row of ``pairs`` (left rows with matches) extends."""
    df, on = _same_rows(left, pairs)
    return Relation(left.df.join(df, on, "left_anti"), left.vars)


def semi(left: Relation, pairs: Relation) -> Relation:
    df, on = _same_rows(left, pairs)
    return Relation(left.df.join(df, on, "left_semi"), left.vars)


def exists(left: Relation, right: Relation, condition: Callable[[Relation], Column] | None, negated: bool) -> Relation:
    """Left rows with (or without) a compatible right row."""
    left_, right_, shared = aligned(left, right)
    if shared and condition is None and not _uncertain(left_, right_):
        on = _equal(shared)
        how = "left_anti" if negated else "left_semi"
        return Relation(left_.df.join(_renamed(right_.select(shared), shared), on, how), left_.vars)
    if shared and condition is not None and not _uncertain(left_, right_):
        on = _equal(shared) & condition(Relation(left_.df, {**right_.vars, **left_.vars}))
        return Relation(left_.df.join(_renamed(right_, shared), on, "left_anti" if negated else "left_semi"), left_.vars)
    if not shared and condition is None:
        held = marked(left, right, None, "m_exists")
        test = ~F.col("m_exists") if negated else F.col("m_exists")
        return Relation(held.df.where(test).drop("m_exists"), left.vars)
    pairs = join(tagged(left_), right_)
    if condition is not None:
        pairs = pairs.where(condition(pairs))
    return (anti if negated else semi)(left_, pairs)


def marked(left: Relation, right: Relation, condition: Callable[[Relation], Column] | None, name: str) -> Relation:
    """Left rows with a boolean column ``name``: whether a right row is compatible.
    Other columns of the left that are no variables stay."""
    others = [c for c in left.df.columns if c not in {column(n) for n in left.vars}]
    left_, right_, shared = aligned(Relation(left.df.drop(*others), left.vars), right)
    if shared and left_.vars == left.vars and not _uncertain(left_, right_):
        # One join, which keeps every left row once with whether it matched.
        # The left columns get names that nothing below the right side has.
        own = left.df.select("*", *[F.col(column(n)).alias(f"o_{column(n)}") for n in left.vars])
        outer = {n: Value(F.col(f"o_{column(n)}").outer(), i.shape) for n, i in left.vars.items()}
        inner = {n: Value(F.col(f"r_{column(n)}" if n in shared else column(n)), i.shape) for n, i in right_.vars.items()}
        test = reduce(lambda a, b: a & b, [inner[n].col == outer[n].col for n in shared])
        if condition is not None:
            test = test & condition(Named({**inner, **outer}))
        held = own.select("*", _renamed(right_, shared).where(test).exists().alias(name))
        return Relation(held.drop(*[f"o_{column(n)}" for n in left.vars]), left.vars)
    if others:
        plain = Relation(left.df.drop(*others), left.vars).distinct()
        held = marked(plain, right, condition, name)
        keys = held.df.select(*[F.col(column(n)).alias(f"r_{column(n)}") for n in left.vars], name)
        on = reduce(lambda a, b: a & b, [F.col(column(n)).eqNullSafe(F.col(f"r_{column(n)}")) for n in left.vars], F.lit(True))
        df = left.df.join(keys, on, "left")
        return Relation(df.select(*[column(n) for n in left.vars], *others, name), left.vars)
    left, right, shared = aligned(left, right)
    if not left.vars or not shared and condition is None:
        found = right.df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
        return Relation(left.df.crossJoin(F.broadcast(found)), left.vars)
    if condition is None and not _uncertain(left, right):
        keys = _renamed(right.select(shared).distinct(), shared).withColumn(name, F.lit(True))
        df = left.df.join(keys, _equal(shared), "left")
    else:
        pairs = join(tagged(left), right)
        if condition is not None:
            pairs = pairs.where(condition(pairs))
        keys, on = _same_rows(left, pairs)
        df = left.df.join(keys.withColumn(name, F.lit(True)), on, "left")
    return Relation(df.select(*[column(n) for n in left.vars], F.coalesce(name, F.lit(False)).alias(name)), left.vars)


def minus(left: Relation, right: Relation) -> Relation:
    """Left rows without a compatible right row that shares a bound variable."""
    left, right, shared = aligned(left, right)
    if not shared:
        return left
    open_left = [n for n in shared if not left.vars[n].certain]
    if open_left:
        bound, rest = _split(left, open_left[0])
        return union(minus(bound, right), minus(rest, right))
    open_right = [n for n in shared if not right.vars[n].certain]
    if open_right:
        for part in _split(right, open_right[0]):
            left = minus(left, part)
        return left
    return Relation(left.df.join(_renamed(right.select(shared), shared), _equal(shared), "left_anti"), left.vars)
