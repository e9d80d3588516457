"""Corpus preparation: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's documents. All stages but the
last return the columns of documents; ``n_chars`` follows the text.

In every stage a null text counts as empty, a text of any length is treated
whole, an empty table gives no rows, and other columns, whatever their names,
come back as they were. What else holds for null and repeated ids and for ties
stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.llm import line_dedup, packing, quality, simhash, suffix_dedup
from trellisq.llm.common import documents, scratch
from trellisq.llm.registry import tokenizer

#: Chunks in a generation of the packing workers' caches, and rows encoded together: less
#: than packing alone has, as the stages before leave the executor's heap grown.
PACKING_HELD = 100_000
PACKING_ROWS = 512


def _recounted(docs: DataFrame, names: list[str]) -> DataFrame:
    """The first columns of ``docs`` by these names, with the text's length."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    length = F.length(f"c{names.index('text')}").cast("long")
    return flat.select(*[(length if n == "n_chars" else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or score below the threshold go. Each
    row is judged alone, so repeated rows share a fate, and a row without doc_id is
    judged like any other; an empty text fails."""
    return quality.keep(docs, documents(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents or more stay in the one of largest doc_id. A
    row without doc_id is smaller than all others; rows that tie for the largest
    doc_id all keep the line. No row goes; a null text comes back empty."""
    return _recounted(line_dedup.drop_repeated(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest
    doc_id: five-word shingles, a similarity of 0.8 or more. Rows that tie for it
    stay, and so do rows without doc_id. Empty texts are copies of each other."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that an earlier document holds go; so does what a
    cut leaves of a character. Rows of equal doc_id take nothing from each other; a
    row without doc_id comes after all others. No row goes."""
    names = docs.columns
    found = suffix_dedup.remove_repeats(docs, as_text=True)
    columns = [F.col("kept" if n == "text" else f"c{i}").alias(n) for i, n in enumerate(names)]
    return _recounted(found.select(*columns), names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts' tokens in sequences of 4096, in the order of the scan. An
    empty text is its end token; repeated rows and rows without doc_id are packed
    like any other."""
    return packing.checksums(packing.pack(docs, tokenizer("word_bpe_49k.json"), held=PACKING_HELD, at_once=PACKING_ROWS))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: Hashes of other libraries decide in several stages; see the tests instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``; what the others
    keep is written to the shared folder between them."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, f"stage-{i + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
