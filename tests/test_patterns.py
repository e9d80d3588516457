"""The pattern API against a brute-force matcher."""

import itertools
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trellisq.deadline import deadline
from trellisq.engine import QueryEngine
from trellisq.functions.terms import decode, encode
from trellisq.sources.dictionary import Dictionary, EncodedTable
from trellisq.sources.store_sources import TripleTable
from trellisq.store import GraphStore, Iri, Literal, StoreClosed, Var


def v(i):
    return Var(f"x{-i}")


def store_of(spark, triples):
    store = GraphStore(spark)
    store.add([tuple(f"n{x}" for x in t) for t in triples])
    return store


def pattern(t):
    return tuple(v(x) if x < 0 else f"n{x}" for x in t)


def brute(triples, patterns):
    """All bindings, one pattern after the other."""
    found = [{}]
    for p in patterns:
        step = []
        for binding in found:
            for t in set(triples):
                more = dict(binding)
                if all(more.setdefault(x, y) == y if x < 0 else x == y for x, y in zip(p, t)):
                    step.append(more)
        found = step
    return sorted(tuple(b[x] for x in sorted(b, reverse=True)) for b in found)


def matched(store, patterns):
    names = sorted({x for p in patterns for x in p if x < 0}, reverse=True)
    rows = store.match([pattern(p) for p in patterns], select=[f"x{-x}" for x in names]).collect()
    return sorted(tuple(int(x[1:]) for x in r) for r in rows)


def generated(seed):
    """A small graph whose nodes are also predicates, so that every place can meet
    every other, and a pattern with each place free, repeated or fixed."""
    pick = random.Random(seed)
    triples = [tuple(pick.choices((7, 8, 9), k=3)) for _ in range(12)]
    return pick, triples


@pytest.mark.parametrize("seed", range(3))
def test_each_place_free_fixed_or_repeated(spark, seed):
    pick, triples = generated(seed)
    store, numbers = store_of(spark, triples), store_of(spark, triples).encoded()
    shapes = [p for p in itertools.product((-1, -2, 0), repeat=3) if -1 in p or -2 not in p]
    for shape in pick.sample(shapes, 6):
        asked = tuple(x or pick.choice((7, 8, 9, 10)) for x in shape)
        want = brute(triples, [asked])
        assert matched(store, [asked]) == want and matched(numbers, [asked]) == want
        assert store.count([pattern(asked)]) == len(want)


@pytest.mark.parametrize("seed", range(3, 7))
def test_conjunctions(spark, seed):
    pick, triples = generated(seed)
    asked = [tuple(pick.choice((-1, -2, -3, 8)) for _ in range(3)) for _ in range(2)]
    asked += [(-5, pick.choice((7, 8, 9)), -6)] if seed % 2 else [(-1, 9, -1)]
    store = store_of(spark, triples)
    assert matched(store, asked) == brute(triples, asked)
    assert store.count([pattern(p) for p in asked]) == len(brute(triples, asked))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(5, 6), st.integers(1, 4)), min_size=1, max_size=30), st.lists(st.tuples(st.sampled_from([-1, -2, 1, 2]), st.sampled_from([5, 6, -3]), st.sampled_from([-1, -2, -4, 3])), min_size=1, max_size=3))
def test_random_patterns(spark, triples, patterns):
    assert matched(store_of(spark, triples), patterns) == brute(triples, patterns)


def test_adding_and_reading(spark):
    store = GraphStore(spark)
    assert store.size() == 0 and store.count([(v(-1), "n2", "n3")]) == 0 and store.match([]).count() == 0
    for i in range(1, 26):
        store.add([("n1", "n2", f"n{i}"), ("n1", "n2", "n1")])
        if i % 8 == 1:
            assert store.count([("n1", "n2", v(-1))]) == i
    assert store.size() == 25 and store.contains(o="n25") and not store.contains(s="n2")
    assert store.find(o="n3").collect() == [("n1", "n2", "n3")]

    def broken():
        yield ("n9", "n9", "n9")
        raise OSError("gone")

    with pytest.raises(OSError):
        store.add(broken())
    assert not store.contains(s="n9")
    with pytest.raises(ValueError):
        store.add([('"x"', "p", "o")])
    with pytest.raises(ValueError):
        store.find(Var("x"))


def test_budget_indexes_and_lifecycle(spark, tmp_path):
    triples = [(1, p, o) for p in (10, 11, 12) for o in (1, 2)] + [(2, 13, 1)]
    store = store_of(spark, triples)
    assert store.count([(v(-1), v(-2), v(-3))], budget=6) is None and store.count([(v(-1), v(-2), v(-3))], budget=7) == 7
    rows, whole = store.match_within([(v(-1), v(-2), v(-3))], 3)
    assert len(rows) == 3 and not whole
    assert {r[0] for r in store.children().collect()} == {"n10", "n11", "n12", "n13"}
    assert {r[0] for r in store.children("sp", s="n1", p="n10").collect()} == {"n1", "n2"}
    assert store.children("s", s="n99").count() == 0
    with pytest.raises(ValueError):
        store.children("sp", s="n1")
    assert store.vertices_by_type() == {"root": 1, "s": 2, "p": 4, "o": 2, "sp": 4, "so": 3, "po": 7}
    assert store.edges_by_type() == {"root": 4, "s": 4, "p": 4, "o": 7, "sp": 7, "so": 7, "po": 7}
    assert store.statistic(p="n10") == 2
    store.write(str(tmp_path / "g"))
    again = GraphStore.read(spark, str(tmp_path / "g"))
    assert again.size() == 7 and again.contains("n2", "n13", "n1")
    with store:
        pass
    with pytest.raises(StoreClosed):
        store.size()


def test_many_additions_are_put_together(spark):
    store = GraphStore(spark)
    for i in range(20):
        store.add([(f"a{i}", "p", "b"), ("same", "p", "b"), (f"a{i - 1}", "p", "b")])
    assert store.size() == 22 and [len(level) for level in store.levels] == [4, 2]
    store.add_frame(spark.createDataFrame([("n", "p", None), (None, "p", "b"), ("n", "p", "b")], "s string, p string, o string"))
    assert store.size() == 23


def test_time_limit(spark):
    slow = spark.range(1 << 40, numPartitions=4).selectExpr("concat('n', id % 7) AS s", "'p' AS p", "concat('m', hash(id) % 5) AS o")
    store = GraphStore(spark, TripleTable(slow), timeout=1.5)
    began = time.time()
    with pytest.raises(TimeoutError):
        store.count([(v(-1), "p", v(-2))])
    assert time.time() - began < 30
    assert store_of(spark, [(1, 2, 3)]).size() == 1
    with deadline(spark, 60):
        assert spark.range(3).count() == 3


def test_engine_protocol(spark):
    assert isinstance(GraphStore(spark), QueryEngine) and not isinstance(object(), QueryEngine)


@pytest.mark.parametrize("bits", [64, 3])
def test_dictionary(spark, bits):
    """With 3 bits nearly all terms share a first number, and one may be 0."""
    terms = [f"t{i}" for i in range(40)] + ["_:x", '"y"@en', "17"]
    rows = [(pick, "t0", terms[-1 - i]) for i, pick in enumerate(terms)]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    d = Dictionary.of(triples, bits)
    held = {r["term"]: r["id"] for r in d.terms.collect()}
    assert set(held) == set(terms) and len(set(held.values())) == len(terms) and 0 not in held.values()
    assert all(d.id_of(t) == held[t] and d.term_of(held[t]) == t for t in terms[::9])
    assert d.id_of("none") is None and d.term_of(0) is None and not d.contains("none") and d.size() == len(terms)
    assert [r["term"] for r in d.blanks().collect()] == ["_:x"]
    store = GraphStore(spark, EncodedTable(triples, d))
    assert sorted(map(tuple, store.find().collect())) == sorted(rows)
    assert {r[0] for r in store.match([(v(-1), "t0", "17")]).collect()} == {s for s, _, o in rows if o == "17"}


@pytest.mark.parametrize("term", [Iri("Plain"), Iri("urn:x"), Literal("a\"b"), Literal("x", lang="en", datatype="http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), Literal("-12", "http://www.w3.org/2001/XMLSchema#integer"), Literal("1.5", "http://www.w3.org/2001/XMLSchema#decimal"), Literal("<a>", "http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral")])
def test_codec(term):
    assert decode(encode(term)) == term


@pytest.mark.parametrize("text", ["", "?", "%x", '"open'])
def test_codec_refuses(text):
    with pytest.raises(ValueError):
        decode(text)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """What a task holds is bounded, whatever the session's number of partitions."""
    from trellisq import store as module

    monkeypatch.setattr(module, "TASK_ROWS", 500)
    monkeypatch.setattr(module, "FEW", 10)
    triples = spark.range(2000).selectExpr("concat('s', id % 500) AS s", "concat('p', id % 3) AS p", "concat('o', id % 7) AS o")
    store = GraphStore(spark)
    store.add_frame(triples.limit(0))
    store.add_frame(triples.where("s < 's2'"))
    store.add_frame(triples)
    store.add([("s1", "p1", "o1"), ("s1", "p1", "o1"), ("new", "p1", "o1")])
    want = {tuple(r) for r in triples.collect()} | {("s1", "p1", "o1"), ("new", "p1", "o1")}
    assert sorted(tuple(r) for r in store.find().collect()) == sorted(want)
    assert max(store.find().rdd.glom().map(len).collect()) < 800
    for counts, pairs in ((store.vertices_by_type(), {"s": "s", "p": "p", "o": "o", "sp": "sp", "so": "so", "po": "po"}), (store.edges_by_type(), {"root": "p", "s": "sp", "p": "sp", "o": "po", "sp": "spo", "so": "spo", "po": "spo"})):
        for name, columns in pairs.items():
            assert counts[name] == len({tuple(t["spo".index(c)] for c in columns) for t in want}), name
