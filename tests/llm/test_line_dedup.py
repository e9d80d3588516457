import random

from trellisq.llm import line_dedup as L


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders: dict[str, list] = {}
    for d, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(L.NO_ID if d is None else d)
    out = []
    for d, text in rows:
        parts = (text or "").split("\n")
        stay = [x for x in parts if len(holders.get(key(x), [])) < 3 or (L.NO_ID if d is None else d) == max(holders[key(x)])]
        out.append((d, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=str)


def table():
    pick = random.Random(6)
    pool = [f"This is common line number {i} of the pool" for i in range(30)] + ["short", "", "ÄÖÜ long enough line é É", "äöü long enough line é é", "exactly twenty chars"[:20], "nineteen characters"[:19]]
    rows = []
    for d in range(120):
        picked = [pick.choice(pool) for _ in range(pick.randint(0, 12))]
        picked = [pick.choice(["", " ", "\t", "\x0b"]) + (x.upper() if x.isascii() and pick.random() < 0.3 else x) + pick.choice(["", "  ", "\r"]) for x in picked]
        rows.append((3 * d, "\n".join(picked + [f"only in document {d} and nowhere else"])))
    rows += [(7, None), (8, ""), (9, "\n\n"), (None, pool[0]), (None, "no id holds this line here"), (None, "no id holds this line here"), (None, "no id holds this line here")]
    rows += [(12, rows[4][1]), (12, rows[4][1]), (500, "This is a very long line " * 5000 + "\n" + pool[1])]
    return rows


def test_drop_repeated_equals_brute_force(spark):
    rows = table()
    frame = spark.createDataFrame([(d, t, 1, "x", d) for d, t in rows], "doc_id long, text string, h1 int, drops string, d long").repartition(4)
    for batches, fanout in ((1, 2), (5, 2)):
        got = L.drop_repeated(frame, batches=batches, fanout=fanout)
        assert got.columns == [*frame.columns, "n_lines", "n_dropped"]
        assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == brute(rows)


def test_shuffled_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_KEYS", -1)
    rows = table()
    got = L.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert L.drop_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_feed(spark, tmp_path):
    runs = L.LineRuns(spark, str(tmp_path / "runs"), fanout=2)
    batches = [[(1, "a line of many characters\nshort"), (2, "A line of many characters")], [(3, "a line of many characters\nanother line that is long")], [(4, "Another line that is long \nshort")], [(5, "yet another line, long too")]]
    kept = [sorted((r["doc_id"], r["line"]) for r in runs.first_seen(spark.createDataFrame(b, "doc_id long, text string")).collect()) for b in batches]
    assert kept == [[(1, "a line of many characters"), (1, "short")], [(3, "another line that is long")], [(4, "short")], [(5, "yet another line, long too")]]
    assert max(map(len, runs.levels)) < 2 and runs.merged().count() == 3


def test_runs_are_merge_joined_where_they_lie(spark, tmp_path):
    runs = L.LineRuns(spark, str(tmp_path / "runs"), fanout=3, buckets=4)
    frame = lambda low, high: spark.range(low, high).selectExpr("id AS h1", "id * 7 AS h2", "1L AS docs", "id AS last")
    hits = [runs.seen(frame(a, a + 100)) for a in (0, 50, 120, 130, 0)]
    assert [h.count() for h in hits] == [0, 50, 30, 90, 100] and len(runs.tables()) > 1
    assert sorted(r["h1"] for r in runs.merged().collect()) == list(range(230))
    with L._merging(spark):
        plan = runs.unheld(frame(0, 300))._jdf.queryExecution().executedPlan().toString()
    joins = len(runs.tables())
    assert plan.count("SortMergeJoin") == joins and plan.count("LeftAnti") == joins
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # the batch's own
    assert {r["h1"]: r["last"] for r in runs.condemned(hits, 3).collect()} == {i: i for i in range(230) if sum(a <= i < a + 100 for a in (0, 50, 120, 130, 0)) >= 3}
    runs.close()
    assert not spark.sql("SHOW TABLES").where(f"tableName LIKE '{runs.name}%'").count()


def test_null_and_clashing_columns(spark):
    rows = [(None, None, 1), (None, "", 2), (3, None, 3), (4, "x" * 30, 4), (4, "x" * 30, 5), (5, "X" * 30, 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, TEXT int")
    got = sorted(((r[0], r[1], r[3], r[4]) for r in L.drop_repeated(frame).collect()), key=str)
    assert got == brute([r[:2] for r in rows])


def test_a_run_is_the_only_copy_of_what_was_fresh(spark, tmp_path, monkeypatch):
    cuts, cut = [], L.cut
    monkeypatch.setattr(L, "cut", lambda df: cuts.append(df) or cut(df))
    runs = L.LineRuns(spark, str(tmp_path / "runs"), fanout=2, buckets=4)
    frame = lambda low, high: spark.range(low, high).selectExpr("id AS h1", "id * 7 AS h2", "1L AS docs", "id AS last")
    told = []
    for low in (0, 5, 8):
        hits = runs.seen(frame(low, low + 10))
        told.append((len(cuts), sorted(r["h1"] for r in hits.collect())))
    assert told == [(1, []), (3, [5, 6, 7, 8, 9]), (5, [8, 9, 10, 11, 12, 13, 14])]
    assert sorted(r["h1"] for r in runs.merged().collect()) == list(range(18))
    runs.close()
