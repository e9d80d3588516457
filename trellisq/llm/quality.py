"""Quality rules: hashed n-gram log-likelihood ratio, in DataFrame operations.

Unigrams and bigrams of words are hashed into BUCKETS. Two multinomials over
the buckets are counted in one pass over all documents: of the trusted ones,
and of all. A document's score is the mean over its n-grams of the logarithm
of the ratio of the two, so that its length doesn't matter, and a document is
kept if the score reaches a fixed threshold. The model is one number a
bucket, whatever the corpus holds; each document is then scored where it lies.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, once, pick

BUCKETS = 32768
#: Added to each bucket's target count and to the count that the raw corpus lets
#: expect; with little evidence a bucket's ratio so stays near one.
SMOOTHING = 10.0
THRESHOLD = -0.1
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
#: Trusted ids are broadcast up to this many (about 24 bytes each), else joined
#: by a shuffle.
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def gram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the unigrams, then of the bigrams, of hashed words."""
    unigrams = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    pairs = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    return F.concat(unigrams, F.transform(pairs, lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int")))


def mean_ratio(hashes: Column, ratio: Column, buckets: int) -> Column:
    """The mean of ``ratio`` over the n-grams' buckets; null without words."""

    def of(h: Column) -> Column:
        return F.get(ratio, F.pmod(h, F.lit(buckets)).cast("int"))

    pairs = F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0)))
    sums = F.transform(pairs, lambda h, i: of(h) + of(F.xxhash64(h, F.get(hashes, i + 1))))
    total = F.aggregate(sums, of(F.try_element_at(hashes, F.lit(-1))), lambda a, b: a + b)
    return total / F.nullif(2 * F.size(hashes) - 1, F.lit(-1))


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that stand twice or more, the first included.

    Windows are compared by a 64-bit hash within their document.
    """
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0)))
    windows = F.transform(starts, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return _covered(windows)


def _covered(windows: Column) -> Column:
    def spots(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = F.transform(_let(ordered), lambda o: F.filter(F.transform(o, lambda p, j: F.when((p["h"] == F.get(o, j - 1)["h"]) | (p["h"] == F.get(o, j + 1)["h"]), p["i"])), lambda i: i.isNotNull()))
        return F.sort_array(F.get(twice, 0))

    def width(s: Column) -> Column:
        return F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(s, j - 1), F.lit(-3)))), F.lit(0).cast("long"), lambda a, b: a + b)

    found = F.transform(_let(windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(F.get(F.transform(_let(spots(w)), width), 0)))
    return F.get(found, 0)


def _let(value: Column) -> Column:
    """A one-element array, over which transform() names a value used often."""
    return F.array(value)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, words, hashes) of every row."""
    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("words", words(F.col("text"))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float] | None:
    """The log-ratio of each bucket; None if no trusted document has a word.

    ``trusted`` holds the doc_ids of the target. Counts cover all documents;
    what comes to the driver is two counts a bucket.
    """
    ids = cut(trusted.select(F.col("doc_id").cast("long").alias("trusted")).where("trusted is not null").distinct())
    few = ids.count() <= BROADCAST_IDS
    grams = gram_buckets(F.col("hashes"), buckets).alias("grams")
    if few:  # one pass counts both
        rows = _hashed(docs).select("doc_id", grams).join(F.broadcast(ids), F.col("doc_id") == F.col("trusted"), "left")
        marked = rows.select(F.col("trusted").isNotNull().alias("t"), F.lit(1).alias("n"), "grams")
    else:  # only what the target needs is joined, and no gram is shuffled
        texts = pick(docs, doc_id="doc_id", text="text")
        target = _hashed(texts.join(ids, F.col("doc_id") == F.col("trusted"), "left_semi")).select(F.lit(True).alias("t"), F.lit(0).alias("n"), grams)
        marked = target.unionAll(_hashed(docs).select(F.lit(False), F.lit(1), grams))
    counts = (
        marked.select(F.col("t").cast("long").alias("t"), "n", F.explode_outer("grams").alias("bucket"))
        .groupBy("bucket")
        .agg(F.sum("t").alias("target"), F.sum("n").alias("raw"))
        .collect()
    )
    target, raw = [0] * buckets, [0] * buckets
    for r in counts:
        if r["bucket"] is None:  # of documents without words
            continue
        target[r["bucket"]], raw[r["bucket"]] = r["target"], r["raw"]
    if not sum(target):
        return None
    share = sum(target) / sum(raw)
    return [round(log((a + smoothing) / (share * b + smoothing)), 6) for a, b in zip(target, raw, strict=True)]


def score(docs: DataFrame, model: list[float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, score, kept.

    A null text counts as empty: it has no words, fails the base rules and has a
    null score. Without a model the base rules alone decide. Every row gives a
    row, also where its doc_id is null or repeated; an empty table gives none. A
    text of any length is measured whole; other columns may have any names.
    """
    rows = _hashed(docs)
    n = F.size("words").cast("long")
    if model is None:
        mean = F.lit(None).cast("double")
    else:
        ratio = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
        mean = mean_ratio(F.col("hashes"), ratio, len(model))
    with_word = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    measured = once(
        rows,
        ["doc_id"],
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.get(F.transform(_let(with_word), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), 0).alias("n_dup_lines"),
        repeated_words(F.col("hashes")).alias("n_repeat_words"),
        mean.alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed)
    verdict = F.lit(True) if model is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & verdict)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids of labelled documents of good quality that aren't toxic."""
    return pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("quality = 1 and toxic = 0").select("doc_id")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, trusted_ids(labels)), threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    packed = flat.select(F.struct(*flat.columns).alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    judged = score(packed, fit(docs, trusted_ids(labels)), threshold)
    return judged.where("kept").select("doc_id.*").toDF(*names)
