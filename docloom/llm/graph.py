"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import maybe_broadcast, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of a component's diameter. Labels that
    fit are broadcast; beyond that every join is between two plain exchanges, which adaptive
    execution can split where a hub is hot. The minimum is combined before its shuffle. Edges with
    a null end are left out; repeated edges and loops change nothing; no edges give no rows.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    links = stored(links.union(links.select("v", "u")).distinct(), "links")
    labels = stored(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).select(F.col("u").alias("node"), "c"), "labels")
    while True:
        at_hand = maybe_broadcast(labels, 128)
        near = links.join(at_hand.select(F.col("node").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
        met = near.select(F.col("u").alias("node"), "near").join(at_hand, "node").select("node", "c", F.least("c", "near").alias("m"))
        of = at_hand.select(F.col("node").alias("m"), F.col("c").alias("mc"))
        step = stored(met.join(of, "m", "left").select("node", F.least("m", "mc").alias("c"), (F.least("m", "mc") != F.col("c")).alias("moved")), "labels")
        moved = step.where("moved").limit(1).count()
        labels = step.select("node", "c")
        if not moved:
            return labels.select("node", F.col("c").alias("component"))
