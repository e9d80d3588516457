"""Property paths over a source.

``/`` ``|`` and ``^`` are joins, unions and swaps and keep duplicates;
``? * +`` give each pair once. A closure grows breadth-first: new pairs are
the frontier joined with the edges, less what was reached. Each step is cut to
the checkpoint folder. From a constant end only what it reaches is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.terms import Iri, Var, encode
from ..functions.values import Shape
from ..plans.algebra import Node, Path, Triple
from ..sources.store_sources import Source
from . import relation as R
from .relation import Info, Relation, column

S, O = "s", "o"
#: Steps of a closure whose pairs are read from as many folders.
STEPS = 16


def _swap(r: Relation) -> Relation:
    df = r.df.select(F.col(column(O)).alias(column(S)), F.col(column(S)).alias(column(O)))
    return Relation(df, {S: r.vars[O], O: r.vars[S]})


def pairs(source: Source, path: Path, start: Node | None = None, end: Node | None = None) -> Relation:
    """(s, o) of the path; constant ends may be used to look at less."""
    if path.kind == "iri":
        return source.scan(Triple(Var(S), Iri(path.iri), Var(O))).select([S, O])
    if path.kind == "inverse":
        return _swap(pairs(source, path.parts[0], end, start))
    if path.kind == "alternative":
        return reduce(R.union, [pairs(source, p, start, end) for p in path.parts])
    if path.kind == "sequence":
        out = pairs(source, path.parts[0], start, None)
        if start is not None and not isinstance(start, Var):
            # Only what the constant reaches goes on.
            out = out.where(R.V.generic(out.value(S)) == encode(start))
        for i, part in enumerate(path.parts[1:], 2):
            step = pairs(source, part, None, end if i == len(path.parts) else None)
            left = Relation(out.df.withColumnRenamed(column(O), column("m")), {S: out.vars[S], "m": out.vars[O]})
            right = Relation(step.df.withColumnRenamed(column(S), column("m")), {"m": step.vars[S], O: step.vars[O]})
            out = R.join(left, right).select([S, O])
        return out
    if path.kind == "negated":
        return _negated(source, path, start, end)
    step = pairs(source, path.parts[0]).distinct()
    if path.kind == "optional":
        return R.union(step, _identity(source, start, end)).distinct()
    reached = closure(step, start, end)
    if path.kind == "plus":
        return reached
    return R.union(reached, _identity(source, start, end)).distinct()


def _negated(source: Source, path: Path, start: Node | None, end: Node | None) -> Relation:
    forward = [p.iri for p in path.parts if p.kind == "iri"]
    back = [p.parts[0].iri for p in path.parts if p.kind == "inverse"]
    found = []
    for banned, swapped in ((forward, False), (back, True)):
        if banned or not swapped and not back:
            ends = (end, start) if swapped else (start, end)
            # Constant ends narrow the scan, and stand as columns afterwards.
            fixed = {n: x for n, x in zip((S, O), ends, strict=True) if x is not None and not isinstance(x, Var)}
            everything = source.scan(Triple(fixed.get(S, Var(S)), Var("p"), fixed.get(O, Var(O))))
            kept = everything.shaped({"p": Shape("any")}).where(~F.col(column("p")).isin(*banned) if banned else F.lit(True))
            df = kept.df.select("*", *[F.lit(encode(x)).alias(column(n)) for n, x in fixed.items()])
            kept = Relation(df, {**kept.vars, **{n: Info(Shape("any")) for n in fixed}}).select([S, O])
            found.append(_swap(kept) if swapped else kept)
    return reduce(R.union, found)


def _identity(source: Source, start: Node | None, end: Node | None) -> Relation:
    """(x, x): of the constant end, or of every node."""
    constants = [n for n in (start, end) if n is not None and not isinstance(n, Var)]
    if constants:
        df = source.spark.range(1).select(F.lit(encode(constants[0])).alias("node"))
    else:
        df = source.resources()
    return Relation(df.select(F.col("node").alias(column(S)), F.col("node").alias(column(O))), {S: Info(Shape("any")), O: Info(Shape("any"))})


def closure(step: Relation, start: Node | None = None, end: Node | None = None) -> Relation:
    """(s, o) of one or more steps, each pair once."""
    shape = step.vars[S].shape if step.vars[S].shape == step.vars[O].shape else Shape("any")
    flat = step.shaped({S: shape, O: shape})
    forward = not (end is not None and not isinstance(end, Var) and (start is None or isinstance(start, Var)))
    edges = flat if forward else _swap(flat)
    fixed = start if forward else end
    edge = cut(edges.df.select(F.col(column(S)).alias("a"), F.col(column(O)).alias("b")))
    frontier = edge
    if fixed is not None and not isinstance(fixed, Var):
        head = Relation(edge.select(F.col("a").alias(column(S)), F.col("b").alias(column(O))), edges.vars)
        text = R.V.generic(head.value(S))
        frontier = head.df.where(text == encode(fixed)).toDF("a", "b")
    frontier = cut(frontier.distinct())
    # What was reached stays where each step wrote it; only many steps are put together.
    steps = [frontier]
    while frontier.limit(1).count():
        ahead = frontier.select("a", F.col("b").alias("m")).join(edge.toDF("m", "b"), "m").select("a", "b").distinct()
        frontier = cut(ahead.join(reduce(DataFrame.unionAll, steps), ["a", "b"], "left_anti"))
        steps.append(frontier)
        if len(steps) > STEPS:
            steps = [cut(reduce(DataFrame.unionAll, steps))]
    found = Relation(reduce(DataFrame.unionAll, steps).toDF(column(S), column(O)), {S: Info(shape), O: Info(shape)})
    return found if forward else _swap(found).select([S, O])


def match(source: Source, s: Node, path: Path, o: Node) -> Relation:
    """Solutions of a path pattern."""
    found = pairs(source, path, s, o)
    names: dict[str, Info] = {}
    tests, cols = [], {}
    for node, name in ((s, S), (o, O)):
        value = found.value(name)
        if isinstance(node, Var):
            if node.name in cols:
                tests.append(R.V.generic(found.value(S)) == R.V.generic(value))
            else:
                cols[node.name], names[node.name] = value.col, Info(value.shape)
        else:
            tests.append(R.V.generic(value) == F.lit(encode(node)))
    kept = found.df.where(reduce(lambda a, b: a & b, tests)) if tests else found.df
    return Relation(kept.select(*[c.alias(column(n)) for n, c in cols.items()]), names)
