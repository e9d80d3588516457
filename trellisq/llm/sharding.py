"""Sharding: a permutation-filled lookup table places every document.

Each shard has its own preference order over the slots of a table of prime
size: a start and a step, both taken from a digest of the shard's name, so
that the order is a permutation. The shards take turns; each claims the
first slot of its order that is still free, until the table is full. A
document goes to the shard that holds slot ``digest(key) mod size``. The
table has a fixed size, so it is broadcast whatever the input holds, and
adding or removing a shard moves few documents.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: A prime, much larger than the number of shards.
TABLE_SIZE = 65537
SHARDS = 64


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The position in ``names`` of each slot's shard.

    No two shards differ by more than one slot. Raises ValueError without
    shards, for repeated names, or if ``size`` isn't a prime above their number.
    """
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names, at least one")
    if size <= len(names) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime size above the number of shards")
    at = [_digest(f"start:{name}") % size for name in names]
    step = [_digest(f"step:{name}") % (size - 1) + 1 for name in names]
    table = [-1] * size
    turn = 0
    for _ in range(size):
        while table[at[turn]] >= 0:
            at[turn] = (at[turn] + step[turn]) % size
        table[at[turn]] = turn
        turn = (turn + 1) % len(names)
    return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; a null key counts as an empty one."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def table_frame(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The table as rows (slot, shard); one row a slot, whatever the input."""
    listed = ",".join(map(str, lookup_table(names, size)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def shard(docs: DataFrame, names: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, slot, shard) for every row of ``docs``.

    Rows of equal keys share a shard. Null keys all go to the shard of the
    empty key. An empty table gives no rows. Texts are not read. The hash is
    of the document's key, so a hot source is dealt over all shards.
    """
    rows = pick(docs, doc_id="doc_id", key=key).select("doc_id", slot(F.col("key"), size).alias("slot"))
    return rows.join(F.broadcast(table_frame(docs.sparkSession, names, size)), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, names: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> None:
    """Write ``docs`` as Parquet below ``path``, one folder a shard (``shard=``).

    Each task writes its own file to each shard, so that no shard's rows meet
    in one task. Of columns whose names differ in case only, or that are named
    shard, the later ones get a number. Null keys share a shard; an empty table
    writes no rows; texts of any length and repeated rows are written as they are.
    """
    columns = docs.columns
    if len({c.lower() for c in [*columns, "shard"]}) <= len(columns):
        # Folders and files name columns without case, so clashing ones are numbered.
        taken: dict[str, int] = {"shard": 1}
        for i, c in enumerate(columns):
            seen = taken.get(c.lower(), 0)
            taken[c.lower()] = seen + 1
            columns[i] = f"{c}_{seen + 1}" if seen else c
    flat = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    keyed = flat.withColumn("_tq_slot", slot(F.col(f"c{docs.columns.index(key)}"), size))
    placed = keyed.join(F.broadcast(table_frame(docs.sparkSession, names, size).toDF("_tq_slot", "shard")), "_tq_slot").drop("_tq_slot")
    placed.toDF(*columns, "shard").write.partitionBy("shard").parquet(path)


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def oracle(count: int = SHARDS, size: int = TABLE_SIZE) -> str:
    listed = ",".join(map(str, lookup_table(shard_names(count), size)))
    return f"""
        WITH slots AS (SELECT [{listed}] AS shards),
        placed AS (
            SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS INTEGER) AS slot
            FROM documents)
        SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM placed, slots"""
