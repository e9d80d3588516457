"""SPARQL features over a small harbour: ships, berths, cargo and pilots."""

import random

import pytest
from evaluator import bgp, exists, join, minus, optional, project, reach

from trellisq.functions.terms import RDF, XSD
from trellisq.plans.parser import SparqlError
from trellisq.store import Blank, GraphStore, Iri, Literal

H = "http://harbour/"
PRE = f"PREFIX h: <{H}>\nPREFIX xsd: <{XSD}>\nPREFIX rdf: <{RDF}>\nPREFIX list: <http://jena.hpl.hp.com/ARQ/list#>\n"


def h(name):
    return H + name


def harbour():
    pick = random.Random(31)
    rows = []
    for i in range(14):
        ship = h(f"ship{i}")
        rows.append((ship, h("called"), f'"Vessel {pick.choice("ABCDEF")}{i % 5}"'))
        rows.append((ship, h("draught"), str(pick.randint(3, 12))))
        if i % 3:
            rows.append((ship, h("moored"), h(f"berth{pick.randint(0, 4)}")))
        for _ in range(pick.randint(0, 2)):
            rows.append((ship, h("carries"), h(pick.choice(["grain", "ore", "wool", "timber"]))))
        if i % 4 == 0:
            rows.append((ship, h("pilot"), h(f"pilot{i % 3}")))
    for b in range(6):
        rows.append((h(f"berth{b}"), h("depth"), str(5 + b)))
        if b:
            rows.append((h(f"berth{b}"), h("beside"), h(f"berth{b - 1}")))
    rows += [(h("pilot0"), h("speaks"), '"Dansk"@da'), (h("pilot1"), h("speaks"), '"English"@en'), (h("pilot1"), h("speaks"), '"Scots"@en-gb'), (h("ore"), h("heavy"), f'"true"^^{XSD}boolean')]
    return list(dict.fromkeys(rows))


ROWS = harbour()


@pytest.fixture(scope="module")
def port(spark):
    store = GraphStore(spark)
    store.add(ROWS)
    return store


def ask(store, query):
    return sorted((tuple(r) for r in store.sparql(PRE + query).collect()), key=str)


def solve(*patterns):
    return bgp(ROWS, *patterns)


CALLED = ("?s", h("called"), "?n")
DRAUGHT = ("?s", h("draught"), "?d")
MOORED = ("?s", h("moored"), "?b")
DEPTH = ("?b", h("depth"), "?m")
CARRIES = ("?s", h("carries"), "?c")


def deep(s):
    return int(s["?d"]) > int(s["?m"])


CASES = {
    "chain": ("SELECT ?n ?m { ?s h:called ?n ; h:moored ?b . ?b h:depth ?m }", lambda: project(solve(CALLED, MOORED, DEPTH), "n", "m")),
    "nothing": ("SELECT ?n { ?s h:sunk ?n }", lambda: []),
    "aground": ("SELECT ?s ?b { ?s h:draught ?d ; h:moored ?b . ?b h:depth ?m FILTER(?d > ?m) }", lambda: project([s for s in solve(DRAUGHT, MOORED, DEPTH) if deep(s)], "s", "b")),
    "at sea": ("SELECT ?n { ?s h:called ?n OPTIONAL { ?s h:moored ?b } FILTER(!BOUND(?b)) }", lambda: project([s for s in optional(solve(CALLED), solve(MOORED)) if "?b" not in s], "n")),
    "optional in optional": (
        "SELECT ?s ?b ?o { ?s h:called ?n OPTIONAL { ?s h:moored ?b OPTIONAL { ?b h:beside ?o } } }",
        lambda: project(optional(solve(CALLED), optional(solve(MOORED), solve(("?b", h("beside"), "?o")))), "s", "b", "o"),
    ),
    "optional with a filter on the outside": (
        "SELECT ?s ?m { ?s h:draught ?d ; h:moored ?b OPTIONAL { ?b h:depth ?m FILTER(?m < ?d) } }",
        lambda: project(optional(solve(DRAUGHT, MOORED), solve(DEPTH), deep), "s", "m"),
    ),
    "optional that a later pattern binds": (
        "SELECT ?s ?b ?m { ?s h:pilot ?p OPTIONAL { ?s h:moored ?b } ?b h:depth ?m }",
        lambda: project(join(optional(solve(("?s", h("pilot"), "?p")), solve(MOORED)), solve(DEPTH)), "s", "b", "m"),
    ),
    "two optionals on one variable": (
        "SELECT ?s ?x { ?s h:called ?n OPTIONAL { ?s h:pilot ?x } OPTIONAL { ?s h:carries ?x } }",
        lambda: project(optional(optional(solve(CALLED), solve(("?s", h("pilot"), "?x"))), solve(("?s", h("carries"), "?x"))), "s", "x"),
    ),
    "minus": ("SELECT ?n { ?s h:called ?n MINUS { ?s h:carries h:ore } }", lambda: project(minus(solve(CALLED), solve(("?s", h("carries"), h("ore")))), "n")),
    "minus of what shares nothing": ("SELECT ?n { ?s h:called ?n MINUS { ?x h:carries ?y } }", lambda: project(solve(CALLED), "n")),
    "minus with an unbound variable": (
        "SELECT ?s ?b { ?s h:draught ?d OPTIONAL { ?s h:moored ?b } MINUS { ?b h:depth 6 } }",
        lambda: project(minus(optional(solve(DRAUGHT), solve(MOORED)), solve(("?b", h("depth"), "6"))), "s", "b"),
    ),
    "exists": ("SELECT ?s { ?s h:called ?n FILTER EXISTS { ?s h:carries ?c . ?c h:heavy true } }", lambda: project([s for s in solve(CALLED) if exists(s, solve(CARRIES, ("?c", h("heavy"), f'"true"^^{XSD}boolean')))], "s")),
    "exists with an outer filter": (
        "SELECT ?s { ?s h:draught ?d FILTER EXISTS { ?s h:moored ?b . ?b h:depth ?m FILTER(?d > ?m) } }",
        lambda: project([s for s in solve(DRAUGHT) if exists(s, solve(MOORED, DEPTH), deep)], "s"),
    ),
    "not exists with an outer filter": (
        "SELECT ?s { ?s h:draught ?d FILTER NOT EXISTS { ?s h:moored ?b . ?b h:depth ?m FILTER(?d > ?m) } }",
        lambda: project([s for s in solve(DRAUGHT) if not exists(s, solve(MOORED, DEPTH), deep)], "s"),
    ),
    "exists among alternatives": (
        "SELECT ?s { ?s h:draught ?d FILTER(?d < 5 || NOT EXISTS { ?s h:moored ?b } || (EXISTS { ?s h:carries h:wool } && ?d != 8) || EXISTS { ?s h:moored ?q . ?q h:depth ?m FILTER(?m = ?d) }) }",
        lambda: project(
            [
                s for s in solve(DRAUGHT)
                if int(s["?d"]) < 5 or not exists(s, solve(MOORED)) or exists(s, solve(("?s", h("carries"), h("wool")))) and s["?d"] != "8" or exists(s, solve(("?s", h("moored"), "?q"), ("?q", h("depth"), "?m")), lambda t: t["?m"] == t["?d"])
            ],
            "s",
        ),
    ),
    "exists of a fixed statement": (f"SELECT ?n {{ <{h('ship0')}> h:called ?n FILTER EXISTS {{ h:ore h:heavy true }} }}", lambda: project(solve((h("ship0"), h("called"), "?n")), "n")),
    "union": ("SELECT ?x { { ?s h:carries ?x } UNION { ?s h:pilot ?x } UNION { ?t h:pilot ?x } }", lambda: project(solve(("?s", h("carries"), "?x")) + 2 * solve(("?s", h("pilot"), "?x")), "x")),
    "union of different variables": ("SELECT ?c ?p { { ?s h:carries ?c } UNION { ?s h:pilot ?p } }", lambda: project(solve(CARRIES) + solve(("?s", h("pilot"), "?p")), "c", "p")),
    "join with a union": (
        "SELECT ?s ?x ?d { ?s h:draught ?d { { ?s h:carries ?x } UNION { ?s h:moored ?x } } }",
        lambda: project(join(solve(DRAUGHT), solve(("?s", h("carries"), "?x")) + solve(("?s", h("moored"), "?x"))), "s", "x", "d"),
    ),
    "distinct": ("SELECT DISTINCT ?c { ?s h:carries ?c }", lambda: sorted({(s["?c"],) for s in solve(CARRIES)})),
    "values": ("SELECT ?s ?w { VALUES (?c ?w) { (h:ore 1) (UNDEF 2) } ?s h:carries ?c }", lambda: sorted([(s["?s"], w) for s in solve(CARRIES) for c, w in ((h("ore"), 1), (None, 2)) if c in (None, s["?c"])], key=str)),
    "hidden nodes": ("SELECT ?n { [] h:pilot [ h:speaks ?l ] ; h:called ?n }", lambda: project(solve(("?s", h("pilot"), "?p"), ("?p", h("speaks"), "?l"), CALLED), "n")),
    "path": (f"SELECT ?x {{ <{h('berth4')}> h:beside+ ?x }}", lambda: sorted((b,) for b in reach([(a, c) for a, p, c in ROWS if p == h("beside")], h("berth4")))),
    "path back": (f"SELECT ?x {{ ?x h:beside* <{h('berth1')}> }}", lambda: sorted((b,) for b in reach([(c, a) for a, p, c in ROWS if p == h("beside")], h("berth1")) | {h("berth1")})),
    "path through": (f"SELECT ?m {{ <{h('ship1')}> h:moored/h:beside?/h:depth ?m }}", lambda: sorted((m,) for b in [o for s, p, o in ROWS if (s, p) == (h("ship1"), h("moored"))] for m in _depths(b))),
    "negated path": (f"SELECT ?o {{ <{h('ship2')}> !(h:called|h:draught) ?o }}", lambda: sorted((o,) for s, p, o in ROWS if s == h("ship2") and p not in (h("called"), h("draught")))),
    "inverse": (f"SELECT ?s {{ <{h('berth2')}> ^h:moored ?s }}", lambda: project(solve(("?s", h("moored"), h("berth2"))), "s")),
}


def _depths(berth):
    near = {berth} | {o for s, p, o in ROWS if (s, p) == (berth, h("beside"))}
    return [o for s, p, o in ROWS if s in near and p == h("depth")]


@pytest.mark.parametrize("name", list(CASES))
def test_equals_the_evaluator(port, name):
    query, want = CASES[name]
    assert ask(port, query) == want()


@pytest.mark.parametrize("name", ["chain", "aground", "optional in optional", "exists with an outer filter", "union", "path", "negated path"])
def test_numbers_for_terms_change_nothing(port, name):
    query, want = CASES[name]
    assert ask(port.encoded(), query) == want()


def test_aggregates(port):
    loads = {}
    for s in solve(CARRIES):
        loads.setdefault(s["?s"], set()).add(s["?c"])
    assert ask(port, "SELECT ?s (COUNT(?c) AS ?k) { ?s h:carries ?c } GROUP BY ?s HAVING(COUNT(?c) > 1)") == sorted((s, len(c)) for s, c in loads.items() if len(c) > 1)
    assert ask(port, "SELECT (COUNT(DISTINCT ?c) AS ?k) { ?s h:carries ?c }") == [(len(set().union(*loads.values())),)]
    draughts = [int(s["?d"]) for s in solve(DRAUGHT)]
    assert ask(port, "SELECT (SUM(?d) AS ?t) (AVG(?d) AS ?m) (MAX(?d) AS ?x) (COUNT(*) AS ?k) { ?s h:draught ?d }") == [(str(sum(draughts)), sum(draughts) / len(draughts), str(max(draughts)), len(draughts))]
    assert ask(port, "SELECT (SUM(?d) AS ?t) (COUNT(*) AS ?k) { ?s h:none ?d }") == [("0", 0)]
    lowest = {}
    for s in solve(MOORED, DRAUGHT):
        lowest[s["?b"]] = min(lowest.get(s["?b"], 99), int(s["?d"]))
    assert ask(port, "SELECT ?m ?low { ?b h:depth ?m { SELECT ?b (MIN(?d) AS ?low) { ?s h:moored ?b ; h:draught ?d } GROUP BY ?b } }") == sorted(((s["?m"], str(lowest[s["?b"]])) for s in solve(DEPTH) if s["?b"] in lowest), key=str)


def test_sums_that_are_too_large_are_errors(spark):
    store = GraphStore(spark)
    store.add([("a", "n", 2**62), ("b", "n", 2**62), ("c", "n", 2**62)])
    assert ask(store, "SELECT (SUM(?x) AS ?t) (COUNT(?x) AS ?k) { ?s <n> ?x }") == [(None, 3)]


def test_expressions(port):
    names = [s["?n"].strip('"') for s in solve(CALLED)]
    assert ask(port, 'SELECT ?x { ?s h:called ?n BIND(CONCAT(LCASE(?n), "?") AS ?x) FILTER(REGEX(?n, "[abc]\\\\d$", "i")) }') == sorted((n.lower() + "?",) for n in names if n[-2] in "ABC")
    assert ask(port, "SELECT ?x { ?s h:draught ?d BIND(?d * 3 AS ?x) FILTER(?x >= 30) }") == sorted((3.0 * int(s["?d"]),) for s in solve(DRAUGHT) if 3 * int(s["?d"]) >= 30)
    assert ask(port, "ASK { h:ore h:heavy true }") == [(True,)] and ask(port, "ASK { h:wool h:heavy true }") == [(False,)]


def test_order(spark):
    store = GraphStore(spark)
    held = ['"pear"', 30, h("quay"), 4, "_:node", h("pier")]
    store.add([(h(f"o{i}"), h("is"), x) for i, x in enumerate(held)])
    order = [r[0] for r in store.sparql(PRE + "SELECT ?x { ?s h:is ?x } ORDER BY ?x").collect()]
    assert order[:3] == ["_:node", h("pier"), h("quay")] and order.index("4") < order.index("30")
    assert [r[0] for r in store.sparql(PRE + "SELECT ?x { ?s h:is ?x FILTER(ISNUMERIC(?x)) } ORDER BY DESC(?x) LIMIT 1 OFFSET 1").collect()] == ["4"]


@pytest.mark.parametrize("hour,found", [(5, False), (7, True), (23, False)])
def test_times(spark, hour, found):
    store = GraphStore(spark)
    store.add([(h("tide"), h("at"), f'"2031-05-06T{hour:02d}:30:00"')])
    query = 'SELECT ?t { ?t h:at ?x BIND(xsd:dateTime(?x) AS ?y) FILTER(?y > xsd:dateTime("2031-05-06T06:00:00") && HOURS(?y) < 20) }'
    assert bool(ask(store, query)) == found


def test_terms(spark, port):
    assert ask(port, 'SELECT ?l { ?p h:speaks ?l FILTER(LANGMATCHES(LANG(?l), "en")) }') == [('"English"@en',), ('"Scots"@en-gb',)]
    assert ask(port, 'SELECT ?l { ?p h:speaks ?l FILTER(LANG(?l) = "da") }') == [('"Dansk"@da',)]
    store = GraphStore(spark)
    store.add([("k", "v", Literal("2.50", XSD + "decimal")), ("k", "v", Literal("+0012", XSD + "integer")), ("k", "v", False), ("k", "v", '"text"'), ("k", "v", '""'), (Blank("b"), "w", Iri("urn:isbn:9"))])
    assert ask(store, "SELECT ?o { <k> <v> ?o FILTER(?o < 3) }") == [(f'"2.50"^^{XSD}decimal',)]
    assert ask(store, "SELECT ?d { <k> <v> ?o BIND(DATATYPE(?o) AS ?d) FILTER(?o = 12) }") == [(XSD + "integer",)]
    assert ask(store, "SELECT ?o { <k> <v> ?o FILTER(?o) }") == sorted([('"text"',), ("12",), (f'"2.50"^^{XSD}decimal',)], key=str)
    assert ask(store, "SELECT ?s { ?s <w> <urn:isbn:9> FILTER(ISBLANK(?s)) }") == [("_:b",)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closures_of_random_graphs(spark, seed):
    pick = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    pairs = {(pick.choice(nodes), pick.choice(nodes)) for _ in range(11)}
    store = GraphStore(spark)
    store.add([(a, "to", b) for a, b in pairs])
    both = {(a, b) for a in nodes for b in reach(pairs, a)}
    held = {x for p in pairs for x in p}
    assert ask(store, "SELECT ?x ?y { ?x <to>+ ?y }") == sorted(both)
    assert ask(store, "SELECT ?x ?y { ?x <to>* ?y }") == sorted(both | {(x, x) for x in held})
    assert ask(store, "SELECT ?x { ?x <to>+ ?x }") == sorted((a,) for a, b in both if a == b)
    assert ask(store, "SELECT ?y { <n0> <to>/<to>* ?y }") == sorted((b,) for m in {b for a, b in pairs if a == "n0"} for b in reach(pairs, m) | {m})
    assert ask(store, "SELECT ?x { <elsewhere> <to>* ?x }") == [("elsewhere",)]


def test_long_chains(spark):
    store = GraphStore(spark)
    store.add([(f"c{i}", "to", f"c{i + 1}") for i in range(40)])
    assert len(ask(store, "SELECT ?y { <c0> <to>+ ?y }")) == 40


def test_lists(spark):
    store = GraphStore(spark)
    store.add([("crew", "of", "_:a"), ("_:a", RDF + "first", '"Ann"'), ("_:a", RDF + "rest", "_:b"), ("_:b", RDF + "first", '"Ben"'), ("_:b", RDF + "rest", RDF + "nil")])
    want = [('"Ann"',), ('"Ben"',)]
    assert ask(store, "SELECT ?m { <crew> <of>/rdf:rest*/rdf:first ?m }") == want
    assert ask(store, "SELECT ?m { <crew> <of> ?l . ?l list:member ?m }") == want
    assert ask(store, 'SELECT ?x { <crew> <of> (?x "Ben") }') == want[:1]


@pytest.mark.parametrize(
    "query",
    [
        "SELECT { ?a ?b ?c }", "SELECT ?a { ?a ?b }", "SELECT ?a { ?a ?b ?c", "DESCRIBE <x>", "SELECT ?a { GRAPH <g> { ?a ?b ?c } }", "SELECT ?a { SERVICE <g> { ?a ?b ?c } }", "CONSTRUCT { ?a ?b ?c } { ?a ?b ?c }",
        "SELECT ?a { ?a no:prefix ?c }", "SELECT ?a (MAX(?c) AS ?n) { ?a ?b ?c }", "SELECT ?a { ?a ?b ?c } OFFSET many", "SELECT (2 AS ?a) { ?a ?b ?c }", "SELECT ?a { ?a ?b ?c } GROUP BY ?c", "INSERT DATA { <a> <b> <c> }",
        "SELECT * { VALUES (?a) { (1 2) } }", "SELECT ?a { ?a ?b 'open }",
    ],
)
def test_refused(spark, query):
    with pytest.raises(SparqlError):
        GraphStore(spark).sparql(query)
