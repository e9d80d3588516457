"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations.

A run holds (h1, h2, docs, last), each key once over all runs: the 128-bit hash
of a line's key, in how many documents of its batch it stands, and the largest
doc_id among them. Runs are files bucketed and sorted by the hash. Each new
batch is dealt into the same buckets and merge-anti-joined with run after run,
none of which moves; what they lack is the batch's own run. When a level has
FANOUT runs they are compacted into one of the next level, so that a key is
rewritten as often as there are levels.

``drop_repeated`` feeds a table from the largest ids to the smallest. So a key is
new in the batch of its last holder, and all others hit a run. Hits are counted;
a key in enough documents is condemned, and its lines before the last go.
``LineRuns.first_seen`` serves an endless feed, in which the first holder stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, delete, scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS = 20
MIN_DOCS = 3
FANOUT = 3
BATCHES = 4
#: Text bytes for each bucket of the runs, about.
BUCKET_BYTES = 64 << 20
#: Condemned keys are broadcast up to this many (24 bytes each), else shuffled.
BROADCAST_KEYS = 500_000
NO_ID = -(2**63)


def key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hashes(parts: Column, min_chars: int) -> Column:
    """128 bits of each line's key, null for a short one."""
    return F.transform(F.transform(parts, key), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"))))


@contextmanager
def _merging(spark: SparkSession) -> Iterator[None]:
    """Bucketed files are one a bucket here, so their order holds in a scan."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled runs below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder.rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def dealt(self, keys: DataFrame) -> DataFrame:
        """A batch's keys in the runs' buckets."""
        return keys.repartition(self.buckets, "h1", "h2")

    def add(self, keys: DataFrame) -> None:
        """Write keys that no run holds as a run, then compact."""
        self._put(keys, 0)
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            # Read as plain files, so that the new run is dealt into one file a bucket.
            files = [f"{self.folder}/level-{level}/{t}" for t in old]
            self._put(self.spark.read.schema("h1 long, h2 long, docs long, last long").parquet(*files), level + 1)
            self.levels[level] = []
            for table in old:
                self._drop(table, level)
            level += 1

    def _put(self, keys: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        table = f"{self.name}_{self.written}"
        self.written += 1
        # Dealt by the bucketing hash first, so that each bucket is one file.
        rows = self.dealt(keys.select("h1", "h2", "docs", "last"))
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/level-{level}/{table}").format("parquet").saveAsTable(table)
        self.levels[level].append(table)
        return table

    def _drop(self, table: str, level: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete(self.spark, f"{self.folder}/level-{level}/{table}")

    def run(self, table: str) -> DataFrame:
        return self.spark.table(table)

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def close(self) -> None:
        """Forget and delete the runs."""
        for table in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels = []
        delete(self.spark, self.folder)

    def merged(self) -> DataFrame:
        """Every key of the runs, which is in one of them only."""
        if not self.tables():
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long, last long")
        return reduce(DataFrame.unionAll, map(self.run, self.tables()))

    def unheld(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: a merge-anti-join with each. Spark deals the
        keys into the runs' buckets; the runs stay."""
        return reduce(lambda df, t: df.join(self.run(t).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti"), self.tables(), keys)

    def first_seen(self, batch: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        """(doc_id, pos, line) of the batch's lines that stay, in a feed where
        only a key's first holder keeps it: the runs' keys are anti-joined away,
        and of equal keys in the batch the smallest (doc_id, pos) stays. Short
        lines all stay. The batch's keys join the runs.
        """
        rows = cut(
            batch.select("doc_id", F.posexplode_outer(lines(F.col("text"))).alias("pos", "line"))
            .select("doc_id", "pos", "line", F.get(hashes(F.array("line"), min_chars), 0).alias("h"))
            .select("doc_id", "pos", "line", "h.h1", "h.h2")
        )
        with _merging(self.spark):
            fresh = self.unheld(rows.where("h1 is not null"))
            first = cut(fresh.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos", "line")).alias("first"), F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last")))
            self.add(first)
        return rows.where("h1 is null").select("doc_id", "pos", "line").unionAll(first.select("first.doc_id", "first.pos", "first.line"))

    def seen(self, keys: DataFrame) -> DataFrame:
        """Add a batch's (h1, h2, docs, last): what the runs lack becomes a run, and
        the rest, which hits a run, is returned."""
        with _merging(self.spark):
            keys = cut(keys)
            some = bool(self.tables())
            # The new run itself holds what was fresh; no other copy of it is written.
            run = self.run(self._put(self.unheld(keys), 0))
            hits = cut(keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")) if some else keys.limit(0)
            self._compact()
        return hits.select("h1", "h2", "docs")

    def condemned(self, hits: list[DataFrame], min_docs: int) -> DataFrame:
        """(h1, h2, last) of the keys that ``min_docs`` documents hold. Only the hits
        are shuffled."""
        with _merging(self.spark):
            more = cut(reduce(DataFrame.unionAll, hits).groupBy("h1", "h2").agg(F.sum("docs").alias("more")))
            found = [self.run(t).join(more.hint("merge"), ["h1", "h2"], "left").where(F.col("docs") + F.coalesce("more", F.lit(0)) >= min_docs).select("h1", "h2", "last") for t in self.tables()]
            return cut(reduce(DataFrame.unionAll, found))


def batch_keys(rows: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, docs, last) of rows (d, text): a key counts once a row."""
    once = F.array_distinct(F.filter(hashes(lines(F.col("text")), min_chars), lambda h: h.isNotNull()))
    # explode() would have its array computed twice, for a filter on its size.
    each = rows.select("d", F.explode_outer(once).alias("h")).where("h is not null").select("d", "h.h1", "h.h2")
    return each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("d").alias("last"))


def drop_repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The columns of ``docs`` with the text's repeated lines taken out, behind
    them n_lines (before) and n_dropped (long).

    A key of at least ``min_chars`` code points that stands in ``min_docs`` rows
    or more loses all its lines but those in the largest doc_id that holds it. A
    null text counts as one empty line and comes back empty. Each row is a
    document, also where a doc_id is repeated; a row without doc_id counts as
    smaller than all others. An empty table gives no rows. Texts and lines may be
    of any length; other columns may have any names.
    """
    spark = docs.sparkSession
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = names.index("doc_id"), names.index("text")
    rows = flat.select(F.coalesce(F.col(f"c{at_id}").cast("long"), F.lit(NO_ID)).alias("d"), F.col(f"c{at_text}").alias("text"))
    cuts = F.percentile_approx("d", [i / batches for i in range(1, batches)], 1000) if batches > 1 else F.array()
    told = rows.agg(cuts.alias("edges"), F.sum(F.octet_length("text")).alias("size")).first()
    edges = sorted(set(told["edges"] or []), reverse=True)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(told["size"] or 0) // BUCKET_BYTES))
    runs = LineRuns(spark, scratch(spark, "line-runs"), fanout, buckets)
    hits = []
    for i in range(len(edges) + 1):  # ranges of ids, the largest first: the scan skips row groups outside
        batch = rows
        if i:
            batch = batch.where(F.col("d") < edges[i - 1])
        if i < len(edges):
            batch = batch.where(F.col("d") >= edges[i])
        hits.append(runs.seen(batch_keys(batch, min_chars)))
    condemned = runs.condemned(hits, min_docs)
    runs.close()
    if condemned.count() <= BROADCAST_KEYS:
        condemned = F.broadcast(condemned)
    placed = rows.select("d", F.xxhash64("text").alias("t"), F.posexplode_outer(hashes(lines(F.col("text")), min_chars)).alias("pos", "h")).where("h is not null").select("d", "t", "pos", "h.h1", "h.h2")
    dropped = placed.join(condemned, ["h1", "h2"]).where("d < last").groupBy("d", "t").agg(F.collect_set("pos").alias("drops"))
    keyed = flat.withColumn("d", F.coalesce(F.col(f"c{at_id}").cast("long"), F.lit(NO_ID))).withColumn("t", F.xxhash64(f"c{at_text}"))
    joined = keyed.join(dropped, ["d", "t"], "left")
    split = joined.withColumn("parts", lines(F.col(f"c{at_text}")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.coalesce(F.col(f"c{at_text}"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    out = split.select(*[(kept if i == at_text else F.col(f"c{i}")).alias(f"c{i}") for i in range(len(names))], F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.toDF(*names, "n_lines", "n_dropped")


def oracle() -> str:
    return f"""
        WITH split AS (
            SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS k FROM split),
        found AS (
            SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
        judged AS (
            SELECT keyed.*, coalesce(keyed.doc_id <> found.last, false) AS dropped FROM keyed LEFT JOIN found USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id"""
