"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, not null).

    The component is its smallest node. In each round a node takes the least
    label among its own, its neighbours' and its label's; the work halves
    distances, so long chains end soon. Labels are cut to the shared folder
    each round, and only two counts reach the driver. No edges: no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.union(both.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(ROUNDS):
        near = both.join(labels.toDF("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        closer = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jumped = closer.join(labels.toDF("next", "far"), "next", "left").select("node", (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved"), F.least("next", F.coalesce("far", "next")).alias("label"))
        jumped = cut(jumped)
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
