import pytest

from trellisq.functions.terms import XSD
from trellisq.sources import ntriples, parsers, turtle
from trellisq.store import GraphStore
from trellisq.streaming.ingest import ingest

LINES = f"""# a comment

<http://a> <http://p> <http://b> .
<http://a> <http://p> <http://b> .   # twice
_:x1 <http://p> _:y .
<http://a> <http://q> "plain" .
<http://a> <http://q> "tab\\tquote\\" back\\\\slash \\u00e9 \\U0001F600 \\\\u0041" .
<http://a> <http://q> "hallo"@DE .
<http://a> <http://q> "-007"^^<{XSD}integer> .
<http://a> <http://q> "1.0"^^<{XSD}decimal> .
<http://a> <http://q> "s"^^<{XSD}string> .
"""
WANT = {
    ("http://a", "http://p", "http://b"), ("_:x1", "http://p", "_:y"), ("http://a", "http://q", '"plain"'),
    ("http://a", "http://q", '"tab\tquote" back\\slash é 😀 \\u0041"'), ("http://a", "http://q", '"hallo"@de'), ("http://a", "http://q", "-7"),
    ("http://a", "http://q", f'"1.0"^^{XSD}decimal'), ("http://a", "http://q", '"s"'),
}


@pytest.fixture
def path(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.nt").write_text(LINES)
    return str(tmp_path / "in" / "x.nt")


def test_load(spark, path):
    assert {tuple(r) for r in ntriples.load(spark, path).collect()} == WANT
    store = GraphStore(spark)
    for _ in range(3):
        store.load_ntriples(path)
    assert store.size() == len(WANT)
    store.load_ntriples(path, bnode_scope="per_load")
    assert store.size() == len(WANT) + 1
    lexical = {r["o"] for r in ntriples.load(spark, path, literal_mode="lexical").collect()}
    assert '"1.0"' in lexical and '"-007"' in lexical


def test_errors(spark, path, tmp_path):
    with pytest.raises(ValueError):
        ntriples.load(spark, "x.ttl")
    bad = tmp_path / "bad.nt"
    bad.write_text('<http://a> <http://p> .\n<http://a> <http://p> "ok" .\n')
    with pytest.raises(Exception, match="not an N-Triples line"):
        ntriples.load(spark, str(bad)).collect()
    assert ntriples.load(spark, str(bad), on_error="skip").count() == 1


def test_stream(spark, path, tmp_path):
    folder = path.rsplit("/", 1)[0]
    ingest(spark, folder, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == WANT


def test_written_lines_read_back(spark, path, tmp_path):
    store = GraphStore(spark)
    store.load(path)
    store.add([("s", "p", '"line\nbreak and \\ and "'), ("s", "p", "<b>x</b>"), ("s", "p", -3)])
    store.write_ntriples(str(tmp_path / "out.nt"))
    again = GraphStore(spark)
    again.load(str(tmp_path / "out.nt"))
    assert {tuple(r) for r in again.find().collect()} == {tuple(r) for r in store.find().collect()}


TURTLE = """@prefix h: <http://h/> .
PREFIX x: <http://x/>
@base <http://base/> .
# two ships
h:a a h:Ship ; h:crew 12 , 3.5 , 1e3 ; h:name "Anne"@EN , '''long
name''' ; h:at <quay> .
_:n h:next [ h:is true ; h:near ( 1 "two" ) ] .
[] h:is "2031-01-01"^^x:date ; .
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "ships.ttl").write_text(TURTLE)
    store = GraphStore(spark)
    store.load(str(tmp_path / "ships.ttl"))
    store.load(str(tmp_path / "ships.ttl"))
    rows = {tuple(r) for r in store.find().collect()}
    plain = {(s, p, o) for s, p, o in rows if not s.startswith("_:d") and not o.startswith("_:d")}
    a, h = "http://h/a", "http://h/"
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    assert plain == {(a, rdf + "type", h + "Ship"), (a, h + "crew", "12"), (a, h + "crew", f'"3.5"^^{XSD}decimal'), (a, h + "crew", f'"1e3"^^{XSD}double'), (a, h + "name", '"Anne"@en'), (a, h + "name", '"long\nname"'), (a, h + "at", "http://base/quay")}
    assert len(rows) == 7 + 1 + 2 + 4 + 1 and ("_:n", h + "next") in {r[:2] for r in rows}
    assert [r[0] for r in store.sparql("SELECT ?m { ?x <http://h/near> ?l . ?l <http://jena.hpl.hp.com/ARQ/list#member> ?m }").collect()] in (["1", '"two"'], ['"two"', "1"])
    for bad in ("h:a h:b h:c .", "<a> <b> .", '"x" <p> <o> .', "<a> <b>+ <c> .", "<a> <b> ?v ."):
        with pytest.raises(ValueError):
            turtle.parse(bad)


def test_parsers_can_be_registered(spark, tmp_path):
    (tmp_path / "x.pairs").write_text("a b\nc d\n")

    def pairs(spark, path, scope="", **options):
        return spark.read.text(path).selectExpr("split(value, ' ')[0] AS s", "'to' AS p", "split(value, ' ')[1] AS o")

    parsers.register("pairs", pairs)
    try:
        store = GraphStore(spark)
        store.load(str(tmp_path / "x.pairs"))
        assert {tuple(r) for r in store.find().collect()} == {("a", "to", "b"), ("c", "to", "d")}
        with pytest.raises(ValueError):
            store.load("x.unknown")
    finally:
        del parsers.PARSERS["pairs"]


def test_comments_and_long_literals(spark, tmp_path):
    """A quote in a comment makes no literal of an IRI, and a literal may be long."""
    (tmp_path / "x.nt").write_text('<http://a> <http://p> <http://b> . # "x" .\n<http://a> <http://p> "' + "long " * 20_000 + '\\u00e9" .\n')
    assert {tuple(r) for r in ntriples.load(spark, str(tmp_path / "x.nt")).collect()} == {("http://a", "http://p", "http://b"), ("http://a", "http://p", '"' + "long " * 20_000 + 'é"')}


def test_a_line_is_matched_once(spark, path):
    text = ntriples.read(spark, path).where("s IS NOT NULL AND o IS NOT NULL")._jdf.queryExecution().executedPlan().toString()
    # One for lines with a backslash, one for others.
    assert text.count("regexp_replace(") == 2 and "regexp_extract(value" not in text
