import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trellisq.llm import fingerprints as I


def table():
    pick = random.Random(8)
    common = ["the", "of", "and"]
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n ", "One", "one", "x " * 3000]
    for _ in range(60):
        texts.append(" ".join(pick.choice(common) if pick.random() < 0.3 else pick.choice(vocabulary) for _ in range(pick.randint(1, 300))))
    texts += [texts[10], texts[10], texts[11].upper()]
    rows = [(7 * i if i % 5 else 100_000 * i, t, "x") for i, t in enumerate(texts)]
    return rows + [(-50, "negative id", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), "doc_id long, text string, hashes string").repartition(4)


def test_order_and_edits(spark, docs):
    rows = sorted(table(), key=lambda r: -r[0])
    got = {r["doc_id"]: (r["n_chars"], r["edited"]) for r in I.compare(docs).collect()}
    assert len(got) == len(rows)
    for (d, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = text or "", following or ""
        third = len(text) // 3
        assert got[d] == (len(text), text[: len(text) - third] + following[:third])


def word_hash(word):
    return xxh64_intdigest(word.encode(), 42)


def chained(numbers):
    """The hash of an array of longs: each element's, seeded with the one before."""
    seed = 42
    for x in numbers:
        seed = xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)
    return seed


def words_of(text):
    return {w for w in re.split("[ \t\n\x0b\x0c\r]+", (text or "").lower()) if w}


def brute(rows):
    """Every column of compare, from its definition."""
    df = Counter(w for _, t in rows for w in words_of(t))
    n = len(rows)
    band = {word_hash(w) for w, k in df.items() if n / 2**I.HIGH <= k <= max(n / 2**I.LOW, 2)}

    def fingerprint(text):
        own = sorted((h - 2**64 if h >= 2**63 else h for h in {word_hash(w) for w in words_of(text)} & band))
        out, shift = [], 0
        for d, k in I.LEVELS:
            for i in range(k):
                some = [t for t in own if (t % 2**64) >> shift & (d - 1) == i]
                out.append(chained(some) if some else None)
            shift += d.bit_length() - 1
        return [*out, None if own else xxh64_intdigest((text or "").encode(), 42)]

    def like(a, b):
        if a == b:
            return 1.0
        at, levels = 0, []
        for _, k in I.LEVELS:
            held = [(x, y) for x, y in zip(a[at : at + k], b[at : at + k]) if x is not None or y is not None]
            levels.append(held)
            at += k
        some = next((x for x in reversed(levels[1:]) if len(x) >= I.ENOUGH), levels[0])
        return sum(x == y for x, y in some) / len(some) if some else 0.0

    spell = lambda f: "".join("-" * 8 if x is None else f"{x:016x}"[:8] for x in f)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for (d, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        third = len(text) // 3
        edit = text[: len(text) - third] + after[:third]
        a, b, c = fingerprint(text), fingerprint(edit), fingerprint(after)
        out.append((d, len(text), edit, spell(a), spell(b), like(a, b), like(a, c)))
    return out


def test_every_column_equals_brute_force(spark, docs):
    rows = [(d, t) for d, t, _ in table()]
    got = I.compare(docs).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r["doc_id"]] or "", set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_edits_are_nearer_than_neighbours(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = I.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert sum(r["near_edited"] for r in got) > 5 * sum(r["near_next"] for r in got) > 0


def test_texts_without_a_term_in_the_band_are_not_alike(spark):
    rows = [(i, t) for i, t in enumerate(["the of and"] * 40 + ["the of", "", " ", "of and the"])]
    got = {r["doc_id"]: r for r in I.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[42]["near_next"] == 0 and got[41]["near_next"] == 0 and got[5]["near_next"] == 1 and got[40]["near_next"] == 0
    assert sorted(map(tuple, got.values())) == sorted(brute(rows))


def test_band_is_exact_with_a_large_vocabulary(spark):
    """Over 2^20 different words: those outside the band stay outside."""
    rare = spark.range(1100, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1000)), lambda i: F.concat_ws("r", "id", i)), " "), F.lit(" every"), F.when(F.col("id") % 40 == 0, F.lit(" banded")).otherwise(F.lit(""))).alias("text"))
    held = I.lexicon(rare, high=9.5)
    assert {x % 2**64 for x in held} == {word_hash("banded")}


@pytest.mark.parametrize("count", [0, 1, 5, 3000])
def test_slots_hold_every_term(count):
    pick = random.Random(count)
    kept = sorted({pick.randrange(-(2**63), 2**63) for _ in range(count)})
    table, bits = I.slots(kept)
    assert sorted(x for x in table if x) == kept and len(table) == 1 << bits
    for t in kept:
        u = t % 2**64
        assert t in (table[u >> (64 - bits)], table[u >> (64 - 2 * bits) & (1 << bits) - 1])


def test_ids_of_any_range(spark):
    ids = [-(2**63), 2**63 - 1, 0, -1, 1, 2**62, -(2**62), None]
    rows = [(d, f"text of {d} and more {i}") for i, d in enumerate(ids)]
    got = I.compare(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, DOC_ID string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_small_tables(spark, docs):
    assert I.compare(docs.limit(0)).count() == 0
    one = I.compare(spark.createDataFrame([(3, "only one text here")], "doc_id long, text string")).collect()
    assert one[0]["edited"] == "only one tex" + "only o" and one[0]["near_next"] == 1.0
    odd = spark.createDataFrame([(None, "no id"), (None, None), (4, "twice same id"), (4, "twice same id"), (4, "other text")], "doc_id long, text string")
    assert I.compare(odd).count() == 5


@pytest.mark.parametrize("size", [1, 500])
def test_many_blocks(spark, docs, monkeypatch, size):
    monkeypatch.setattr(I, "BLOCK_BYTES", size)
    test_order_and_edits(spark, docs)
    assert I._block is not None
    edges = sorted(random.Random(size).sample(range(-(10**6), 10**6), 300))
    values = [*edges, edges[0] - 1, edges[-1] + 1, *(e + 1 for e in edges[::7])]
    got = spark.createDataFrame([(v,) for v in values], "d long").select("d", I._block(F.col("d"), edges).alias("b")).collect()
    assert all(r["b"] == sum(e <= r["d"] for e in edges) for r in got)
