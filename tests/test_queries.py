"""The registered queries against DuckDB on the smallest tables, and their plans."""

import duckdb
import pytest

import __spark_entry__
from trellisq import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Q.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    found = duck.execute(Q.oracle_sql()[name])
    order = [[d[0] for d in found.description].index(c) for c in df.columns]
    assert plain(df.collect()) == plain([tuple(r[i] for i in order) for r in found.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_star_is_one_scan(spark):
    text = plan(Q.queries()["bgp_star"](spark, SF))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_constants_reach_the_scan(spark):
    text = plan(Q.queries()["bgp_constant_subject"](spark, SF))
    assert "EqualTo(n_nationkey,3)" in text and "n_regionkey" not in text


def test_joins_are_not_nested_loops(spark):
    for name in ("bgp_path4_join", "bgp_triangle", "optional", "exists", "minus"):
        assert "NestedLoop" not in plan(Q.queries()[name](spark, SF)), name


def test_whole_store_is_whole(spark):
    tables = {r["child"].split("/")[-1].split("#")[0] for r in Q.queries()["api_children_root"](spark, SF).collect() if "#" in r["child"] and r["child"].startswith("http://data/")}
    assert tables == set(Q.TABLES)


def test_more_hashes(spark):
    import hashlib

    names = {r["r_regionkey"]: r["r_name"].encode() for r in spark.read.parquet(f"{SF}/region.parquet").collect()}
    got = {(r["k"], r["a"], r["b"]) for r in Q.queries()["more_hashes"](spark, SF).collect()}
    assert got == {(k, hashlib.sha384(n).hexdigest(), hashlib.sha512(n).hexdigest()) for k, n in names.items()}


@pytest.mark.parametrize("name,columns", [("count_bgp", {"l_orderkey"}), ("bgp_path4_join", {"l_orderkey", "l_extendedprice", "l_discount"})])
def test_computed_keys_are_not_computed_unasked(spark, name, columns):
    text = plan(Q.queries()[name](spark, SF))
    read = [line.split("ReadSchema: struct<")[1].rstrip(">") for line in text.splitlines() if "ReadSchema" in line and "l_orderkey" in line]
    assert "sha2" not in text and {c.split(":")[0] for c in read[0].split(",")} == columns


def test_exists_with_a_filter_is_one_join(spark):
    text = plan(Q.queries()["exists_correlated_filter"](spark, SF))
    assert text.count("LeftSemi") == 1 and "Aggregate" not in text and text.count("FileScan") == 2
    text = plan(Q.queries()["exists_in_or"](spark, SF))
    assert text.count("ExistenceJoin") == 2 and "Aggregate" not in text


def test_filters_have_rows(spark):
    assert Q.queries()["filter_regex"](spark, "/root/testdata/sf0.01").count() > 0


def test_match_all_reads_a_table_once(spark):
    """A row's triples lie together, and no table's wide columns are shuffled."""
    text = plan(Q.queries()["api_match_all"](spark, SF))
    assert text.count("lineitem.parquet") == 1 and text.count("sha2(") == 1
    assert all("text#" not in line for line in text.splitlines() if "Exchange" in line)
