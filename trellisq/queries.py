"""The driver's queries over its tables: SPARQL, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .checkpoints import shared_dir
from .functions.terms import RDF, XSD, Iri, Var
from .sources.dictionary import Dictionary
from .sources.mapping import BASE, Table
from .sources.mapping import TABLES as MAPPED
from .sources.store_sources import TripleTable
from .store import GraphStore
from .streaming.ingest import ingest

TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark embeddings conversations".split()
HEAD = "PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n" + "".join(f"PREFIX {t}: <{BASE}{t}#>\n" for t in TABLES)

PATH4 = "?l lineitem:ref-l_orderkey ?o ; lineitem:l_extendedprice ?price ; lineitem:l_discount ?discount . ?o orders:ref-o_custkey ?c . ?c customer:ref-c_nationkey ?n . ?n nation:n_name ?nation"
#: A conversation's turns in a row, for recursive SQL.
NEXT = "edges AS (SELECT a.conv_id || '/' || a.turn AS a, b.conv_id || '/' || b.turn AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def iri(table: str, key: str) -> str:
    return f"'{BASE}{table}/' || {key}"


#: name -> (SPARQL, SQL)
SPARQL: dict[str, tuple[str, str | None]] = {
    "flagship_revenue": (
        f"SELECT ?nation (ROUND(SUM(?price * (1 - ?discount)) * 100) / 100 AS ?revenue) (COUNT(*) AS ?lines) {{ {PATH4} . ?o orders:o_orderdate ?date FILTER(?date >= \"1996-01-01T00:00:00\"^^xsd:dateTime) }} GROUP BY ?nation ORDER BY ?nation",
        "SELECT n_name AS nation, floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1",
    ),
    "bgp_two_table_join": ("SELECT ?n ?r { ?x nation:n_name ?n ; nation:ref-n_regionkey ?y . ?y region:r_name ?r }", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "bgp_star": ("SELECT ?n ?b ?m { ?c customer:c_name ?n ; customer:c_acctbal ?b ; customer:c_mktsegment ?m }", "SELECT c_name AS n, c_acctbal AS b, c_mktsegment AS m FROM customer"),
    "bgp_path4_join": (
        f"SELECT ?nation ?price ?discount {{ {PATH4} }}",
        "SELECT n_name AS nation, l_extendedprice AS price, l_discount AS discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "bgp_triangle": (
        "SELECT ?c ?s ?n { ?l lineitem:ref-l_orderkey ?o ; lineitem:ref-l_suppkey ?s . ?o orders:ref-o_custkey ?c . ?c customer:ref-c_nationkey ?n . ?s supplier:ref-s_nationkey ?n }",
        f"SELECT {iri('customer', 'c_custkey')} AS c, {iri('supplier', 's_suppkey')} AS s, {iri('nation', 'c_nationkey')} AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey = s_nationkey",
    ),
    "bgp_cartesian": ("SELECT ?r ?m { ?x region:r_name ?r { SELECT DISTINCT ?m { ?c customer:c_mktsegment ?m } } }", "SELECT r_name AS r, m FROM region, (SELECT DISTINCT c_mktsegment AS m FROM customer)"),
    "bgp_constant_subject": (f"SELECT ?n {{ <{BASE}nation/3> nation:n_name ?n }}", "SELECT n_name AS n FROM nation WHERE n_nationkey = 3"),
    "bgp_constant_object": ('SELECT ?c { ?c customer:c_mktsegment "BUILDING" }', f"SELECT {iri('customer', 'c_custkey')} AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "bgp_constant_predicate": ("SELECT ?s ?o { ?s supplier:s_acctbal ?o }", f"SELECT {iri('supplier', 's_suppkey')} AS s, s_acctbal AS o FROM supplier"),
    "bgp_fully_bound": (f"ASK {{ <{BASE}nation/3> nation:ref-n_regionkey <{BASE}region/3> }}", "SELECT count(*) > 0 AS ask FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3"),
    "bgp_repeated_var": (
        "SELECT ?k ?n { ?c customer:c_custkey ?k ; customer:c_name ?n . ?s supplier:s_suppkey ?k }",
        "SELECT c_custkey AS k, c_name AS n FROM customer JOIN supplier ON c_custkey = s_suppkey",
    ),
    "bgp_variable_predicate": (
        f"SELECT ?p ?o {{ <{BASE}nation/3> ?p ?o }}",
        "SELECT p, o FROM nation, LATERAL (VALUES ('http://data/nation#n_nationkey', n_nationkey::VARCHAR), ('http://data/nation#n_name', '\"' || n_name || '\"'), ('http://data/nation#n_regionkey', n_regionkey::VARCHAR), "
        f"('http://data/nation#ref-n_regionkey', {iri('region', 'n_regionkey')}), ('{RDF}type', 'http://data/nation')) t(p, o) WHERE n_nationkey = 3",
    ),
    "bgp_type": (f"SELECT ?p ?n {{ ?p a <{BASE}part> ; part:p_name ?n }}", f"SELECT {iri('part', 'p_partkey')} AS p, p_name AS n FROM part"),
    "bgp_blank_node": ("SELECT ?n { [] nation:ref-n_regionkey [ region:r_name ?n ] }", "SELECT r_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "select_star": ("SELECT * { ?x region:r_name ?name }", f"SELECT {iri('region', 'r_regionkey')} AS x, r_name AS name FROM region"),
    "count_bgp": ("SELECT (COUNT(*) AS ?n) { ?l lineitem:ref-l_orderkey ?o . ?o orders:ref-o_custkey ?c }", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "filter_numeric": ("SELECT ?k ?b { ?c customer:c_custkey ?k ; customer:c_acctbal ?b FILTER(?b > 5000 && ?b <= 9000.5) }", "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal <= 9000.5"),
    "filter_and_or_not": (
        'SELECT ?k { ?p part:p_partkey ?k ; part:p_size ?s ; part:p_brand ?b FILTER((?s < 10 || ?s > 40) && !(?b = "Brand#11")) }',
        "SELECT p_partkey AS k FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT p_brand = 'Brand#11'",
    ),
    "filter_in": ("SELECT ?k ?s { ?p part:p_partkey ?k ; part:p_size ?s FILTER(?s IN (1, 7, 9)) FILTER(?k NOT IN (3, 4)) }", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size IN (1, 7, 9) AND p_partkey NOT IN (3, 4)"),
    "filter_regex": ('SELECT ?k ?n { ?p part:p_partkey ?k ; part:p_name ?n FILTER(REGEX(?n, "^(RED|bl).*t$", "i")) }', "SELECT p_partkey AS k, p_name AS n FROM part WHERE regexp_matches(p_name, '(?i)^(RED|bl).*t$')"),
    "filter_datetime_cast": (
        'SELECT ?k { ?o orders:o_orderkey ?k ; orders:o_orderdate ?d FILTER(?d >= xsd:dateTime("1995-06-01T00:00:00") && xsd:dateTime(?d) < xsd:dateTime("1996-01-01T00:00:00")) }',
        "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
    ),
    "filter_bound_absent": ("SELECT ?k { ?d documents:doc_id ?k OPTIONAL { ?d labels:quality ?q } FILTER(!BOUND(?q)) }", "SELECT doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "exists": ("SELECT ?k { ?d documents:doc_id ?k FILTER EXISTS { ?d labels:toxic 1 } }", "SELECT doc_id AS k FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"),
    "not_exists": ("SELECT ?k { ?d documents:doc_id ?k FILTER NOT EXISTS { ?d labels:quality ?q } }", "SELECT doc_id AS k FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "exists_in_or": (
        "SELECT ?k { ?d documents:doc_id ?k ; documents:n_chars ?n FILTER(?n > 5000 || EXISTS { ?d labels:toxic 1 } || NOT EXISTS { ?d labels:quality ?q }) }",
        "SELECT d.doc_id AS k FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars > 5000 OR coalesce(toxic, 0) = 1 OR l.doc_id IS NULL",
    ),
    "exists_correlated_filter": (
        "SELECT ?k { ?c customer:c_custkey ?k ; customer:c_acctbal ?b ; customer:ref-c_nationkey ?n FILTER EXISTS { ?s supplier:ref-s_nationkey ?n ; supplier:s_acctbal ?t FILTER(?t > ?b) } }",
        "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal)",
    ),
    "optional": ("SELECT ?k ?q { ?d documents:doc_id ?k OPTIONAL { ?d labels:quality ?q } }", "SELECT d.doc_id AS k, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "optional_nested": (
        "SELECT ?k ?q ?t { ?d documents:doc_id ?k OPTIONAL { ?d labels:quality ?q FILTER(?q = 1) OPTIONAL { ?d labels:toxic ?t FILTER(?t = 1) } } }",
        "SELECT d.doc_id AS k, quality AS q, CASE WHEN toxic = 1 THEN toxic END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality = 1",
    ),
    "optional_filter_scope": (
        "SELECT ?k ?q { ?d documents:doc_id ?k ; documents:n_chars ?n OPTIONAL { ?d labels:quality ?q FILTER(?n > 2000) } }",
        "SELECT d.doc_id AS k, quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 2000",
    ),
    "optional_then_join_unbound": (
        "SELECT ?k ?q ?r { ?d documents:doc_id ?k OPTIONAL { ?d labels:quality ?q } VALUES (?q ?r) { (0 \"bad\") (1 \"good\") } }",
        "SELECT d.doc_id AS k, coalesce(l.quality, v.q) AS q, v.r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN (VALUES (0, 'bad'), (1, 'good')) v(q, r) ON l.quality IS NULL OR l.quality = v.q",
    ),
    "union": ("SELECT ?n { { ?x nation:n_name ?n } UNION { ?y region:r_name ?n } }", "SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region"),
    "union_widening": ("SELECT ?a ?b { { ?x nation:n_name ?a } UNION { ?y region:r_name ?b } }", "SELECT n_name AS a, NULL AS b FROM nation UNION ALL SELECT NULL, r_name FROM region"),
    "minus": ("SELECT ?k { ?d documents:doc_id ?k MINUS { ?d labels:quality 1 } }", "SELECT doc_id AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "values": ('SELECT ?k ?m { ?c customer:c_custkey ?k ; customer:c_mktsegment ?m VALUES ?m { "BUILDING" "MACHINERY" } }', "SELECT c_custkey AS k, c_mktsegment AS m FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "bind": ("SELECT ?k ?d { ?p part:p_partkey ?k ; part:p_size ?s BIND(?s * 2 + 1 AS ?d) }", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) * 2 + 1 AS d FROM part"),
    "distinct": ("SELECT DISTINCT ?m { ?c customer:c_mktsegment ?m }", "SELECT DISTINCT c_mktsegment AS m FROM customer"),
    "reduced": ("SELECT REDUCED ?l { ?d documents:lang ?l }", "SELECT DISTINCT lang AS l FROM documents"),
    "count_distinct": ("SELECT (COUNT(DISTINCT ?m) AS ?n) { ?c customer:c_mktsegment ?m }", "SELECT count(DISTINCT c_mktsegment) AS n FROM customer"),
    "count_distinct_star": ("SELECT (COUNT(DISTINCT *) AS ?n) { [] documents:lang ?l ; documents:source ?s }", "SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, lang, source FROM documents)"),
    "group_count": ("SELECT ?m (COUNT(?c) AS ?n) { ?c customer:c_mktsegment ?m } GROUP BY ?m", "SELECT c_mktsegment AS m, count(*) AS n FROM customer GROUP BY 1"),
    "group_expression": ("SELECT ?y (COUNT(*) AS ?n) { ?o orders:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "group_min_max": ("SELECT ?s (MIN(?n) AS ?low) (MAX(?n) AS ?high) { ?d documents:source ?s ; documents:n_chars ?n } GROUP BY ?s", "SELECT source AS s, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY 1"),
    "group_sum_avg": (
        "SELECT ?s (SUM(?n) AS ?total) (AVG(?n) AS ?mean) (SUM(DISTINCT ?n) AS ?once) { ?d documents:source ?s ; documents:n_chars ?n } GROUP BY ?s",
        "SELECT source AS s, CAST(sum(n_chars) AS BIGINT) AS total, avg(n_chars) AS mean, CAST(sum(DISTINCT n_chars) AS BIGINT) AS once FROM documents GROUP BY 1",
    ),
    "sample": ("SELECT ?r (SAMPLE(?n) AS ?one) { ?x nation:n_regionkey ?r ; nation:n_name ?n } GROUP BY ?r", "SELECT n_regionkey AS r, min(n_name) AS one FROM nation GROUP BY 1"),
    "group_concat_sorted": ('SELECT ?r (GROUP_CONCAT(?n; SEPARATOR="|") AS ?all) { ?x nation:n_regionkey ?r ; nation:n_name ?n } GROUP BY ?r', "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS \"all\" FROM nation GROUP BY 1"),
    "having": ("SELECT ?c (COUNT(*) AS ?n) { ?o orders:o_custkey ?c } GROUP BY ?c HAVING(COUNT(*) > 12)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "subselect_filter": ("SELECT ?s ?n { { SELECT ?s (COUNT(?d) AS ?n) { ?d documents:source ?s } GROUP BY ?s } FILTER(?n > 30) }", "SELECT source AS s, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 30"),
    "subselect_join_min": (
        "SELECT ?name ?low { ?n nation:n_name ?name { SELECT ?n (MIN(?b) AS ?low) { ?c customer:ref-c_nationkey ?n ; customer:c_acctbal ?b } GROUP BY ?n } }",
        "SELECT n_name AS name, min(c_acctbal) AS low FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name",
    ),
    "order_limit": ("SELECT ?k ?b { ?c customer:c_custkey ?k ; customer:c_acctbal ?b } ORDER BY ?b ?k LIMIT 10", "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY 2, 1 LIMIT 10"),
    "order_desc_offset": ("SELECT ?k ?t { ?o orders:o_orderkey ?k ; orders:o_totalprice ?t } ORDER BY DESC(?t) ?k OFFSET 5 LIMIT 20", "SELECT o_orderkey AS k, o_totalprice AS t FROM orders ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 5"),
    "str_fns": (
        'SELECT ?k (UCASE(?n) AS ?u) (LCASE(?n) AS ?l) (STRLEN(?n) AS ?c) (SUBSTR(?n, 2, 3) AS ?s) (STRBEFORE(?n, "_") AS ?before) (STRAFTER(?n, "_") AS ?after) (CONCAT(?n, "-", ?n) AS ?two) (CONTAINS(?n, "1") AS ?has) (STRSTARTS(?n, "N") AS ?starts) (STRENDS(?n, "2") AS ?ends) (REPLACE(?n, "[0-9]", "x") AS ?r) (ENCODE_FOR_URI(CONCAT(?n, " /é*~")) AS ?e) { ?x nation:n_nationkey ?k ; nation:n_name ?n }',
        "SELECT n_nationkey AS k, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS c, substr(n_name, 2, 3) AS s, split_part(n_name, '_', 1) AS before, substr(n_name, strpos(n_name, '_') + 1) AS after, n_name || '-' || n_name AS two, contains(n_name, '1') AS has, starts_with(n_name, 'N') AS starts, suffix(n_name, '2') AS ends, regexp_replace(n_name, '[0-9]', 'x', 'g') AS r, n_name || '%20%2F%C3%A9%2A~' AS e FROM nation",
    ),
    "math_fns": (
        "SELECT ?k (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (-?b AS ?m) (?b / 4 AS ?q) (?b - 1.5 AS ?d) { ?s supplier:s_suppkey ?k ; supplier:s_acctbal ?b }",
        "SELECT s_suppkey AS k, abs(s_acctbal) AS a, ceil(s_acctbal) AS c, floor(s_acctbal) AS f, floor(s_acctbal + 0.5) AS r, -s_acctbal AS m, s_acctbal / 4 AS q, s_acctbal - 1.5 AS d FROM supplier",
    ),
    "date_fns": (
        "SELECT ?k (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?i) { ?e events:event_id ?k ; events:ts ?d }",
        "SELECT event_id AS k, year(ts) AS y, month(ts) AS m, day(ts) AS a, hour(ts) AS h, minute(ts) AS i FROM events",
    ),
    "hash_fns": ("SELECT ?k (MD5(?n) AS ?m) (SHA1(?n) AS ?s) (SHA256(?n) AS ?t) { ?x nation:n_nationkey ?k ; nation:n_name ?n }", "SELECT n_nationkey AS k, md5(n_name) AS m, sha1(n_name) AS s, sha256(n_name) AS t FROM nation"),
    "if_coalesce": (
        'SELECT ?k (IF(?n > 2000, "long", "short") AS ?size) (COALESCE(?q, -1) AS ?quality) { ?d documents:doc_id ?k ; documents:n_chars ?n OPTIONAL { ?d labels:quality ?q } }',
        "SELECT d.doc_id AS k, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size, coalesce(CAST(quality AS BIGINT), -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "casts": (
        "SELECT ?k (xsd:string(?k) AS ?s) (xsd:integer(?b) AS ?i) (xsd:double(?k) AS ?d) (xsd:boolean(?k) AS ?t) (xsd:integer(?n) AS ?none) { ?s_ supplier:s_suppkey ?k ; supplier:s_acctbal ?b ; supplier:s_name ?n }",
        "SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS s, CAST(trunc(s_acctbal) AS BIGINT) AS i, CAST(s_suppkey AS DOUBLE) AS d, s_suppkey <> 0 AS t, CAST(NULL AS BIGINT) AS none FROM supplier",
    ),
    "term_fns": (
        "SELECT ?k (STR(?x) AS ?s) (DATATYPE(?n) AS ?t) (ISIRI(?x) AS ?i) (ISLITERAL(?n) AS ?l) (ISNUMERIC(?k) AS ?m) (ISBLANK(?x) AS ?b) (LANG(?n) AS ?g) (SAMETERM(?x, ?x) AS ?e) { ?x nation:n_nationkey ?k ; nation:n_name ?n }",
        f"SELECT n_nationkey AS k, {iri('nation', 'n_nationkey')} AS s, 'http://www.w3.org/2001/XMLSchema#string' AS t, true AS i, true AS l, true AS m, false AS b, '' AS g, true AS e FROM nation",
    ),
    "term_makers": (
        'SELECT ?k (STRDT(?n, xsd:token) AS ?t) (STRLANG(?n, "en") AS ?g) (LANGMATCHES(LANG(STRLANG(?n, "en-GB")), "EN") AS ?m) (IRI(CONCAT("http://x/", ?n)) AS ?i) (BNODE(?n) AS ?b) (ISBLANK(BNODE()) AS ?fresh) { ?x nation:n_nationkey ?k ; nation:n_name ?n }',
        "SELECT n_nationkey AS k, '\"' || n_name || '\"^^http://www.w3.org/2001/XMLSchema#token' AS t, '\"' || n_name || '\"@en' AS g, true AS m, 'http://x/' || n_name AS i, '_:' || n_name AS b, true AS fresh FROM nation",
    ),
    "time_fns": (
        "SELECT ?k (xsd:integer(SECONDS(?d) * 1000000) AS ?s) (TZ(?d) AS ?z) (TIMEZONE(?d) AS ?none) (NOW() > ?d AS ?past) { ?e events:event_id ?k ; events:ts ?d }",
        "SELECT event_id AS k, CAST(date_part('microsecond', ts) AS BIGINT) AS s, '' AS z, NULL AS \"none\", true AS past FROM events",
    ),
    "more_hashes": ("SELECT ?k (SHA384(?n) AS ?a) (SHA512(?n) AS ?b) { ?x region:r_regionkey ?k ; region:r_name ?n }", None),
    "random_fns": (
        "SELECT ?k (RAND() < 1 AS ?r) (ISIRI(UUID()) AS ?u) (STRLEN(STRUUID()) AS ?l) { ?x region:r_regionkey ?k }",
        "SELECT r_regionkey AS k, true AS r, true AS u, 36 AS l FROM region",
    ),
    "more_casts": (
        "SELECT ?k (xsd:double(xsd:decimal(?b)) AS ?d) (xsd:float(?k) AS ?f) (xsd:string(xsd:dateTime(\"2020-02-03T04:05:06\")) AS ?t) { ?x supplier:s_suppkey ?k ; supplier:s_acctbal ?b }",
        "SELECT s_suppkey AS k, s_acctbal AS d, CAST(s_suppkey AS DOUBLE) AS f, '2020-02-03T04:05:06' AS t FROM supplier",
    ),
    "distinct_aggregates": (
        'SELECT ?m (AVG(DISTINCT ?n) AS ?mean) (COUNT(DISTINCT ?n) AS ?c) (MIN(DISTINCT ?n) AS ?low) (GROUP_CONCAT(DISTINCT ?n; SEPARATOR=",") AS ?nations) { ?c_ customer:c_mktsegment ?m ; customer:c_nationkey ?n } GROUP BY ?m',
        "SELECT c_mktsegment AS m, avg(DISTINCT c_nationkey) AS mean, count(DISTINCT c_nationkey) AS c, min(c_nationkey) AS low, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS nations FROM customer GROUP BY 1",
    ),
    "theta_join": (
        "SELECT ?a ?b { { ?x supplier:s_suppkey ?a ; supplier:s_acctbal ?v ; supplier:s_nationkey ?n } { ?y supplier:s_suppkey ?b ; supplier:s_acctbal ?w ; supplier:s_nationkey ?n } FILTER(?v < ?w) }",
        "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_acctbal < y.s_acctbal",
    ),
    "path_sequence_plus": (
        f"SELECT ?y {{ <{BASE}conversations/1/0> conversations:next/conversations:next+ ?y }}",
        f"SELECT {iri('conversations', 'conv_id')} || '/' || turn AS y FROM conversations WHERE conv_id = 1 AND turn >= 2",
    ),
    "path_sequence": ("SELECT ?c ?r { ?c customer:ref-c_nationkey/nation:ref-n_regionkey/region:r_name ?r }", f"SELECT {iri('customer', 'c_custkey')} AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "path_inverse": (f"SELECT ?n {{ <{BASE}region/1> ^nation:ref-n_regionkey ?n }}", f"SELECT {iri('nation', 'n_nationkey')} AS n FROM nation WHERE n_regionkey = 1"),
    "path_alternative": ("SELECT ?x ?n { ?x customer:ref-c_nationkey|supplier:ref-s_nationkey ?n }", f"SELECT {iri('customer', 'c_custkey')} AS x, {iri('nation', 'c_nationkey')} AS n FROM customer UNION ALL SELECT {iri('supplier', 's_suppkey')}, {iri('nation', 's_nationkey')} FROM supplier"),
    "path_optional": (f"SELECT ?y {{ <{BASE}nation/3> nation:ref-n_regionkey? ?y }}", f"SELECT '{BASE}nation/3' AS y UNION SELECT {iri('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 3"),
    "path_plus": (
        "SELECT ?x ?y { ?x conversations:next+ ?y }",
        f"WITH RECURSIVE {NEXT}, reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a) SELECT {iri('conversations', 'a')} AS x, {iri('conversations', 'b')} AS y FROM reach",
    ),
    "path_star": (
        f"SELECT ?y {{ <{BASE}conversations/1/0> conversations:next* ?y }}",
        f"SELECT {iri('conversations', 'conv_id')} || '/' || turn AS y FROM conversations WHERE conv_id = 1 UNION SELECT '{BASE}conversations/1/0'",
    ),
    "path_negated": (f"SELECT ?o {{ <{BASE}region/2> !region:r_regionkey ?o }}", f"SELECT '\"' || r_name || '\"' AS o FROM region WHERE r_regionkey = 2 UNION ALL SELECT '{BASE}region'"),
}


def _sparql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: GraphStore.over_tables(spark, sf_dir).sparql(HEAD + text)


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _store(spark: SparkSession, sf_dir: str, *tables: str) -> GraphStore:
    store = GraphStore.over_tables(spark, sf_dir)
    if tables:
        store.source.tables = {t: store.source.tables[t] for t in tables}
    return store


def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(_store(spark, sf_dir).find())


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _store(spark, sf_dir).find(p=Iri(f"{BASE}customer#c_mktsegment"), o='"BUILDING"')
    return found.limit(1).agg((F.count(F.lit(1)) > 0).alias("held"))


def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).find(p=Iri(f"{BASE}nation#n_name"))


def children_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).children("root")


def statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _n(_store(spark, sf_dir).find(p=Iri(f"{BASE}orders#o_orderstatus"), o='"F"'))


def match_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, n = Var("x"), Var("y"), Var("n")
    return _store(spark, sf_dir).match([(x, f"{BASE}supplier#ref-s_nationkey", y), (y, f"{BASE}nation#n_name", n)], select=["x", "n"])


def match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).match([(Var("s"), Var("p"), Var("o"))])


# ---- SQL for the triples of tables

_DOUBLES = "c_acctbal s_acctbal p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax value".split()
_TIMES = "o_orderdate l_shipdate ts".split()
_WHOLE = "r_regionkey n_nationkey n_regionkey c_custkey c_nationkey s_suppkey s_nationkey p_partkey p_size o_orderkey o_custkey l_orderkey l_partkey l_suppkey l_linenumber event_id user_id doc_id n_chars quality toxic page_id item_id vec_id label conv_id turn".split()


def _plain(c: str) -> str:
    """A column's text as Spark casts it."""
    if c in _DOUBLES:
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS DECIMAL(38,0)) AS VARCHAR) || '.0' ELSE CAST({c} AS VARCHAR) END"
    return f"CAST({c} AS VARCHAR)"


def _term(c: str) -> str:
    """A column's canonical text."""
    if c in _WHOLE:
        return f"CAST({c} AS VARCHAR)"
    if c in _DOUBLES:
        return f"'\"' || ({_plain(c)}) || '\"^^{XSD}double'"
    if c in _TIMES:
        return f"'\"' || replace(CAST({c} AS VARCHAR), ' ', 'T') || '\"^^{XSD}dateTime'"
    return f"'\"' || {c} || '\"'"


def _key(table: Table) -> str:
    if table.fingerprint:
        parts = " || '|' || ".join(f"coalesce(length({_plain(c)}) || ':' || ({_plain(c)}), '-')" for c in table.key)
        return f"sha256({parts})"
    return " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in table.key)


def triples_sql(*names: str) -> str:
    """SQL for (s, p, o) of these tables, or of all."""
    parts = []
    for t in MAPPED.values():
        if names and t.name not in names:
            continue
        subject = f"'{BASE}{t.subject_table}/' || {_key(t)}"
        parts += [f"SELECT {subject} AS s, '{BASE}{t.name}#{c}' AS p, {_term(c)} AS o FROM {t.name} WHERE {c} IS NOT NULL" for c in t.columns]
        parts += [f"SELECT {subject}, '{BASE}{t.name}#ref-{c}', '{BASE}{target}/' || {c} FROM {t.name} WHERE {c} IS NOT NULL" for c, target in t.refs.items()]
        if not t.subject:
            parts.append(f"SELECT {subject}, '{RDF}type', '{BASE}{t.name}' FROM {t.name}")
        if t.name == "events":
            parts.append(f"SELECT {subject}, '{BASE}events#user', '{BASE}user/' || user_id FROM events WHERE user_id IS NOT NULL")
        if t.name == "conversations":
            parts.append(f"SELECT '{BASE}conversations/' || a, '{BASE}conversations#next', '{BASE}conversations/' || b FROM (WITH {NEXT} SELECT a, b FROM edges)")
    return " UNION ALL ".join(parts)


# ---- the store of triples, over the tables of trade

TRADE = ("region", "nation", "customer", "supplier", "orders")
_TRADE_SQL = triples_sql(*TRADE)


def _trade(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TRADE) -> DataFrame:
    """(s, p, o) of whole tables."""
    return _store(spark, sf_dir, *tables).source.triples()


def _held(spark: SparkSession, sf_dir: str) -> GraphStore:
    """A store of triples that were added table by table, some of them twice."""
    store = GraphStore(spark)
    for t in (*TRADE, "nation"):
        store.add_frame(_trade(spark, sf_dir, (t,)))
    return store


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def nt_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as N-Triples and loaded again, twice into one store."""
    path = _folder(spark, "trade") + ".nt"
    GraphStore(spark, TripleTable(_trade(spark, sf_dir))).write_ntriples(path)
    store = GraphStore(spark)
    store.load(path)
    store.load_ntriples(path)
    return store.find()


def nt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Triples files read as a stream."""
    path, out = _folder(spark, "lines"), _folder(spark, "stream")
    GraphStore(spark, TripleTable(_trade(spark, sf_dir, ("region", "nation", "supplier")))).write_ntriples(path)
    ingest(spark, path, out, _folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).distinct()


def add_then_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).sparql(HEAD + "SELECT ?c ?r { ?x customer:c_name ?c ; customer:ref-c_nationkey ?n . ?n nation:ref-n_regionkey ?y . ?y region:r_name ?r }")


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "store")
    _held(spark, sf_dir).write(path)
    return GraphStore.read(spark, path).find()


def store_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _held(spark, sf_dir)
    return spark.range(1).select(F.lit(store.contains(p=Iri(f"{BASE}nation#n_name"))).alias("held"), F.lit(store.contains(s=Iri(f"{BASE}nation/none"))).alias("missing"))


def children_of(index: str, **fixed: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _held(spark, sf_dir).children(index, **fixed)


def edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).edge_counts()


def vertices_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).vertex_counts()


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget one too small, and one that is enough, give."""
    store, patterns = _held(spark, sf_dir), [(Var("x"), f"{BASE}nation#n_name", Var("n"))]
    few, all_few = store.match_within(patterns, 24)
    enough, all_enough = store.match_within(patterns, 25)
    counts = [store.count(patterns, budget=24), store.count(patterns, budget=25)]
    return spark.createDataFrame([(len(few), all_few, len(enough), all_enough, *counts)], "few long, few_whole boolean, enough long, enough_whole boolean, small_count long, count long")


def encoded_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns joined by the terms' numbers."""
    return GraphStore(spark, TripleTable(_trade(spark, sf_dir))).encoded().sparql(HEAD + "SELECT ?k ?n { ?o orders:o_orderkey ?k ; orders:ref-o_custkey ?c . ?c customer:ref-c_nationkey ?y . ?y nation:n_name ?n }")


def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term once, with whether its number leads back to it."""
    triples = _trade(spark, sf_dir)
    dictionary = Dictionary.of(triples)
    coded = dictionary.encode(dictionary.terms.select("term", F.col("term").alias("back")), "back")
    return dictionary.decode(coded, "back").select("term", (F.col("term") == F.col("back")).alias("same"))


def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by term and terms by number; asking for what isn't there adds nothing."""
    d = Dictionary.of(_trade(spark, sf_dir, ("region", "nation")))
    before, name = d.size(), f"{BASE}nation/3"
    missing = (d.id_of("http://none"), d.term_of(12345), d.contains("http://none"))
    row = (d.term_of(d.id_of(name)), d.contains(name), missing == (None, None, False), d.size() - before, d.blanks().count())
    return spark.createDataFrame([row], "term string, held boolean, missing boolean, added long, blanks long")


def encoded_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphStore(spark, TripleTable(_trade(spark, sf_dir, ("region", "nation", "supplier")))).encoded().find()


def list_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of RDF lists: each conversation's turns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("then"))
    cell = F.concat(F.lit("_:c"), F.concat_ws("t", "conv_id", "turn"))
    after = F.when(F.col("then").isNull(), F.lit(f"{RDF}nil")).otherwise(F.concat(F.lit("_:c"), F.concat_ws("t", "conv_id", "then")))
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    triples = c.select(cell.alias("s"), F.lit(f"{RDF}first").alias("p"), F.col("turn").cast("string").alias("o")).unionAll(c.select(cell, F.lit(f"{RDF}rest"), after))
    triples = triples.unionAll(first.select(F.concat(F.lit("http://c/"), "conv_id"), F.lit("http://turns"), cell))
    store = GraphStore(spark)
    store.add_frame(triples)
    return store.sparql("PREFIX list: <http://jena.hpl.hp.com/ARQ/list#> SELECT ?c ?t { ?c <http://turns> ?l . ?l list:member ?t }")


def turtle_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations written as a Turtle document and loaded."""
    path = _folder(spark, "nations") + ".ttl"
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.format_string("<http://data/nation/%d> a :Nation ; :name \"\"\"%s\"\"\" ; :in [ :key %d ] .", "n_nationkey", "n_name", "n_regionkey")
    document = n.agg(F.concat_ws("\n", F.lit("@prefix : <http://n/> ."), F.array_sort(F.collect_list(line))).alias("value"))
    document.write.option("lineSep", "\n").text(path)
    store = GraphStore(spark)
    store.load(path)
    return store.sparql("PREFIX : <http://n/> SELECT ?n ?name ?r { ?n a :Nation ; :name ?name ; :in [ :key ?r ] }")


def _distinct(*columns: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM t))"


def _children(fixed: dict[str, str], child: str) -> str:
    return f"SELECT DISTINCT {child} AS child FROM ({_TRADE_SQL}) WHERE " + " AND ".join(f"{k} = '{v}'" for k, v in fixed.items())


_NAME, _IN, _ASIA = f"{BASE}nation#n_name", f"{BASE}nation#ref-n_regionkey", f"{BASE}region/2"
_CHILDREN = {"s": ({"s": f"{BASE}nation/3"}, "p"), "p": ({"p": _NAME}, "s"), "o": ({"o": _ASIA}, "p"), "sp": ({"s": f"{BASE}nation/3", "p": _IN}, "o"), "so": ({"s": f"{BASE}nation/3", "o": f"{BASE}nation"}, "p"), "po": ({"p": _IN, "o": _ASIA}, "s")}

#: name -> (function, SQL)
PATTERNS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "api_size": (size, f"SELECT count(*) AS n FROM ({triples_sql()})"),
    "api_contains": (contains, "SELECT count(*) > 0 AS held FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "api_find": (find, f"SELECT {iri('nation', 'n_nationkey')} AS s, '{BASE}nation#n_name' AS p, '\"' || n_name || '\"' AS o FROM nation"),
    "api_children_root": (children_root, f"SELECT DISTINCT p AS child FROM ({triples_sql()})"),
    "api_statistic": (statistic, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'"),
    "api_match": (match_patterns, f"SELECT {iri('supplier', 's_suppkey')} AS x, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "api_match_all": (match_all, triples_sql()),
    "nt_load": (nt_load, _TRADE_SQL),
    "nt_stream": (nt_stream, triples_sql("region", "nation", "supplier")),
    "turtle_load": (turtle_load, f"SELECT {iri('nation', 'n_nationkey')} AS n, '\"' || n_name || '\"' AS name, CAST(n_regionkey AS VARCHAR) AS r FROM nation"),
    "store_add_then_match": (add_then_match, "SELECT '\"' || c_name || '\"' AS c, '\"' || r_name || '\"' AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "store_roundtrip": (store_roundtrip, _TRADE_SQL),
    "store_contains": (store_contains, "SELECT true AS held, false AS missing"),
    **{f"store_children_{i}": (children_of(i, **fixed), _children(fixed, child)) for i, (fixed, child) in _CHILDREN.items()},
    "store_edges_by_type": (
        edges_by_type,
        f"WITH t AS ({_TRADE_SQL}) SELECT {_distinct('p')} AS root, {_distinct('s', 'p')} AS s, {_distinct('s', 'p')} AS p, {_distinct('p', 'o')} AS o, {_distinct('s', 'p', 'o')} AS sp, {_distinct('s', 'p', 'o')} AS so, {_distinct('s', 'p', 'o')} AS po",
    ),
    "store_vertices_by_type": (
        vertices_by_type,
        f"WITH t AS ({_TRADE_SQL}) SELECT 1 AS root, {_distinct('s')} AS s, {_distinct('p')} AS p, {_distinct('o')} AS o, {_distinct('s', 'p')} AS sp, {_distinct('s', 'o')} AS so, {_distinct('p', 'o')} AS po",
    ),
    "store_budget": (budget, "SELECT 24 AS few, false AS few_whole, 25 AS enough, true AS enough_whole, NULL::BIGINT AS small_count, count(*) AS count FROM nation"),
    "encoded_match": (
        encoded_match,
        "SELECT CAST(o_orderkey AS VARCHAR) AS k, '\"' || n_name || '\"' AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "encoded_roundtrip": (encoded_roundtrip, triples_sql("region", "nation", "supplier")),
    "dictionary_terms": (dictionary_terms, f"SELECT s AS term, true AS same FROM ({_TRADE_SQL}) UNION SELECT p, true FROM ({_TRADE_SQL}) UNION SELECT o, true FROM ({_TRADE_SQL})"),
    "dictionary_lookup": (dictionary_lookup, f"SELECT '{BASE}nation/3' AS term, true AS held, true AS missing, 0 AS added, 0 AS blanks"),
    "list_member": (list_member, "SELECT 'http://c/' || conv_id AS c, CAST(turn AS VARCHAR) AS t FROM conversations"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sparql(text) for name, (text, _) in SPARQL.items()} | {name: f for name, (f, _) in PATTERNS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in [*SPARQL.items(), *PATTERNS.items()] if sql}
