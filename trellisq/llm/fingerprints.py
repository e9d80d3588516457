"""Document fingerprints: I-Match with randomised lexicons, in DataFrame operations.

A document's terms are its different words, lower-cased. The lexicon keeps
the terms whose inverse document frequency, log2(N / df), lies in a band: neither so common
that many documents have them nor so rare that one edit removes them. It is
exact, counted over all documents by 64-bit hashes of the terms, and its size
is bounded whatever the corpus: a document frequency of at least N / 2^HIGH
leaves at most 2^HIGH times a document's mean number of different words.

Fixed random subsets of the lexicon, the same for every document, are drawn by
a term's hash: a level of density 1/d cuts the lexicon into d classes, of which
the first n are subsets. There are dense levels for short documents and sparse
ones for long. A fingerprint holds for each subset the hash of the document's
sorted terms in it. An edit changes only the subsets in which a term comes or
goes, so the share of equal hashes tells how alike two documents are; it is
read off the sparsest level at which the two hold enough subsets.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, once, pick

#: The band of log2(N / df).
LOW, HIGH = 4.0, 9.0
#: (d, n): density 1/d, d a power of two, and n subsets.
LEVELS = ((4, 4), (32, 10), (256, 20), (2048, 32))
SUBSETS = sum(n for _, n in LEVELS)
#: Subsets that hold a term in either document, for a level to tell their likeness.
ENOUGH = 6
#: Terms of a lexicon; more can't be in the band unless documents are very long.
MOST_TERMS = 1 << 22
#: Documents in order are cut into blocks of about so many bytes of text.
BLOCK_BYTES = 4 << 20
BLOCKS = 1 << 16
PART_BYTES = 16 << 20
NO_ID = -(2**63)


def terms(text: Column) -> Column:
    """The different words' hashes."""
    trimmed = F.btrim(F.coalesce(F.lower(text), F.lit("")), F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """The sorted hashes of the band's terms. Their number is bounded by the mean
    number of different words times 2^high, however large the corpus is."""
    found = docs.select(F.explode_outer(terms(docs["text"])).alias("term"), F.lit(1).alias("one"))
    counted = cut(found.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df"))
    total = docs.count()
    held = counted.where((F.col("term") != 0) & (F.col("df") >= total / 2**high) & (F.col("df") <= max(total / 2**low, 2.0)))
    # A term whose hash is 0 would look like an empty slot; it is left out.
    kept = sorted(r["term"] for r in held.select("term").limit(MOST_TERMS + 1).collect())
    if len(kept) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms in the band: lower its upper end")
    return kept


def _longs(numbers: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def slots(kept: list[int]) -> tuple[list[int], int]:
    """The lexicon as a table of 2^bits slots, and bits. A term lies in the slot of
    its first bits or in that of its next bits, so two looks tell exactly
    whether it is held. 0 stands in an empty slot."""
    bits = max(1, (3 * len(kept)).bit_length())
    while True:
        table, mask = [0] * (1 << bits), (1 << bits) - 1

        def placed(term: int, table: list[int] = table, bits: int = bits, mask: int = mask) -> bool:
            at = (term % 2**64) >> (64 - bits)
            for _ in range(500):
                term, table[at] = table[at], term
                if not term:
                    return True
                first, second = (term % 2**64) >> (64 - bits), (term % 2**64) >> (64 - 2 * bits) & mask
                at = second if at == first else first
            return False

        if all(placed(t) for t in kept if t):
            return table, bits
        bits += 1


def hashes(text: Column, kept: list[int]) -> Column:
    """The hash of each subset's terms, null where there is none; behind them the
    text's own hash if no subset holds a term, else null."""
    table, bits = slots(kept)
    held_terms = _longs(table)

    def known(t: Column) -> Column:
        first = F.get(held_terms, F.shiftrightunsigned(t, 64 - bits).cast("int"))
        second = F.get(held_terms, F.shiftrightunsigned(t, 64 - 2 * bits).bitwiseAND((1 << bits) - 1).cast("int"))
        return (first == t) | (second == t)

    def level(held: Column, d: int, n: int, shift: int) -> Column:
        def own(t: Column) -> Column:
            return F.shiftrightunsigned(t, shift).bitwiseAND(d - 1)

        def each(few: Column) -> Column:
            return F.transform(F.array(*[F.lit(i) for i in range(n)]), lambda i: F.filter(few, lambda t: own(t) == i))

        # Named by a lambda, what the level keeps is computed once.
        return F.get(F.transform(F.array(held if n == d else F.filter(held, lambda t: own(t) < n)), each), 0)

    def classes(held: Column) -> Column:
        out, shift = [], 0
        for d, n in LEVELS:
            out.append(level(held, d, n, shift))
            shift += d.bit_length() - 1
        return F.transform(F.concat(*out), lambda s: F.when(F.size(s) > 0, F.xxhash64(s)))

    own = F.array_sort(F.filter(terms(text), known)) if kept else F.array().cast("array<long>")
    found = F.get(F.transform(F.array(own), classes), 0)
    whole = F.when(F.size(own) == 0, F.xxhash64(text))
    return F.concat(found, F.array(whole)) if kept else F.concat(F.array_repeat(F.lit(None).cast("long"), SUBSETS), F.array(whole))


def spelt(found: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits a subset, or as many dashes."""
    return F.array_join(F.transform(found, lambda h: F.coalesce(F.lower(F.substring(F.lpad(F.hex(h), 16, "0"), 1, 8)), F.lit("-" * 8))), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints. Else, at the sparsest level at which at least
    ENOUGH subsets hold a term in either, or at the densest, the share of
    these subsets that are equal; 0 if none holds a term."""
    shares, start = [], 1
    for _, n in LEVELS:
        x, y = F.slice(a, start, n), F.slice(b, start, n)
        either = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p, q)), lambda p: p.isNotNull()))
        both = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda p: p))
        shares.append((either, both))
        start += n
    out = F.coalesce(shares[0][1] / F.nullif(shares[0][0], F.lit(0)), F.lit(0.0))
    for either, both in shares[1:]:
        out = F.when(either >= ENOUGH, both / F.greatest(either, F.lit(1))).otherwise(out)
    return F.when(a == b, F.lit(1.0)).otherwise(out)


def fingerprints(docs: DataFrame, kept: list[int] | None = None) -> DataFrame:
    """(doc_id, text, hashes, fingerprint) of every row. A null text counts as
    empty; a text without terms in the lexicon has its own hash as fingerprint."""
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    found = once(rows, ["doc_id", "text"], hashes(F.col("text"), lexicon(rows) if kept is None else kept).alias("hashes"))
    return found.withColumn("fingerprint", spelt(F.col("hashes")))


def _block(d: Column, edges: list[int]) -> Column:
    """How many of the sorted edges aren't above d, found in two steps."""
    if not edges:
        return F.lit(0)
    step = isqrt(len(edges)) + 1
    chunks = [edges[i : i + step] for i in range(0, len(edges), step)]
    at = F.size(F.filter(_longs([c[0] for c in chunks]), lambda e: e <= d)) - 1
    own = F.get(F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";"), F.greatest(at, F.lit(0)))
    return F.when(at < 0, F.lit(0)).otherwise(at * step + F.size(F.filter(F.split(own, ",").cast("array<long>"), lambda e: e <= d)))


def with_next(rows: DataFrame, kept: list[int]) -> DataFrame:
    """``rows`` (doc_id, text) with hashes, next_text and next_hashes: those of the
    next row by descending doc_id, and of the first after the last.

    Rows without doc_id come last; rows of equal doc_id are ordered by text. Ids
    are cut into blocks at their quantiles, whatever their range, and each block
    gets a copy of the first document of the block below, so that no window
    spans the table.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("held", F.col("doc_id").isNotNull()).withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    blocks = min(BLOCKS, max(4 * parts, -(-size // BLOCK_BYTES)))
    quantiles = F.percentile_approx("d", [i / blocks for i in range(1, blocks)], 4 * blocks) if blocks > 1 else F.array()
    edges = sorted(set(keyed.agg(quantiles.alias("edges")).first()["edges"] or [])) if blocks > 1 else []
    keyed = keyed.withColumn("block", _block(F.col("d"), edges))
    order = Window.orderBy(F.col("block"))
    heads = cut(keyed.groupBy("block").agg(F.max("d").alias("head")))  # at most BLOCKS rows
    below = heads.select("block", F.coalesce(F.lag("head").over(order), F.max("head").over(Window.partitionBy())).alias("below"))
    copies = keyed.withColumnRenamed("block", "own").join(F.broadcast(below), F.col("d") == F.col("below")).drop("own", "below")
    whole = keyed.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    # Hashed after the union: neither the bounds nor the copies hash every text again.
    every = once(whole, ["doc_id", "text", "held", "d", "block", "copy"], hashes(F.col("text"), kept).alias("hashes")).repartition(parts, "block")
    within = Window.partitionBy("block").orderBy("copy", F.col("held").desc(), F.col("d").desc(), F.col("text").desc())
    led = every.select("*", F.lead("text").over(within).alias("next_text"), F.lead("hashes").over(within).alias("next_hashes"))
    return led.where("copy = 0").drop("copy", "block", "d", "held")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the beginning of the next."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def compare(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited (its edited text), fingerprint,
    edited_fingerprint, near_edited, near_next.

    The lexicon is counted over all texts as they are, of any length. A null text
    counts as empty. Every row gives a row, repeated rows too; equal texts have
    equal fingerprints, and different texts without a term in the band have a
    likeness of 0. A table of one row has itself as next; an empty table gives no
    rows. Ids of any range do, and other columns of any name.
    """
    rows = pick(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    kept = lexicon(rows)
    led = with_next(rows, kept).select("doc_id", F.length("text").cast("long").alias("n_chars"), "hashes", "next_hashes", edited(F.col("text"), F.col("next_text")).alias("edited"))
    both = once(led, ["doc_id", "n_chars", "edited", "hashes", "next_hashes"], hashes(F.col("edited"), kept).alias("edited_hashes"))
    return both.select(
        "doc_id",
        "n_chars",
        "edited",
        spelt(F.col("hashes")).alias("fingerprint"),
        spelt(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
