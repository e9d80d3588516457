"""Rewrites of a basic graph pattern before Spark sees it.

Patterns on one subject that one table answers become a single scan (a key is
unique, so no self-join is needed). The units are then put in a greedy order:
the most bound first, then always one that shares a variable with what is
there, so that a product comes only where the query asks for one.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions.terms import Var
from .algebra import Triple

Unit = list[Triple]


def variables(unit: Unit) -> set[str]:
    return {n.name for t in unit for n in (t.s, t.p, t.o) if isinstance(n, Var)}


def stars(triples: list[Triple], key: Callable[[Triple], str | None]) -> list[Unit]:
    units: dict[object, Unit] = {}
    for i, t in enumerate(triples):
        table = key(t)
        units.setdefault((t.s, table) if table is not None else i, []).append(t)
    return [list(dict.fromkeys(u)) for u in units.values()]


def weight(unit: Unit) -> tuple[int, int, int]:
    """Smaller for units that more constants narrow; a variable predicate is last."""
    constants = sum(not isinstance(n, Var) for t in unit for n in (t.s, t.o))
    subjects = sum(not isinstance(t.s, Var) for t in unit)
    return sum(isinstance(t.p, Var) for t in unit), -subjects, -constants


def ordered(units: list[Unit]) -> list[Unit]:
    left, out, seen = list(units), [], set()
    while left:
        linked = [u for u in left if variables(u) & seen] or left
        best = min(linked, key=weight)
        left.remove(best)
        out.append(best)
        seen |= variables(best)
    return out
