"""An evaluator for graph patterns in plain Python, written from the definitions.

A solution is a dict; a pattern list is matched one pattern after the other.
Names that start with '?' are variables. Operators take and give lists of
solutions, so a test states its query once as text and once in these terms.
"""

from __future__ import annotations


def bgp(triples, *patterns):
    found = [{}]
    for pattern in patterns:
        step = []
        for solution in found:
            for triple in set(triples):
                more = dict(solution)
                if all((more.setdefault(x, y) == y) if x.startswith("?") else x == y for x, y in zip(pattern, triple, strict=True)):
                    step.append(more)
        found = step
    return found


def agree(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def join(left, right):
    return [a | b for a in left for b in right if agree(a, b)]


def optional(left, right, test=lambda s: True):
    out = []
    for a in left:
        matches = [a | b for b in right if agree(a, b) and test(a | b)]
        out += matches or [a]
    return out


def minus(left, right):
    return [a for a in left if not any(agree(a, b) and a.keys() & b.keys() for b in right)]


def exists(solution, right, test=lambda s: True):
    return any(agree(solution, b) and test(solution | b) for b in right)


def project(solutions, *names):
    return sorted((tuple(s.get(f"?{n}") for n in names) for s in solutions), key=str)


def reach(pairs, start):
    """What one or more steps lead to."""
    seen, front = set(), {start}
    while front:
        front = {b for a, b in pairs if a in front} - seen
        seen |= front
    return seen
