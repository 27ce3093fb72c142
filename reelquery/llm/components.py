"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node reachable, for every node of ``edges`` (a, b).

    Each round gives a node the smallest label of itself and its neighbours, then replaces the label by
    that label's own label, so a path of n nodes takes about log n rounds. Rounds are written to the
    shared folder; only one count per round comes to the driver. No edges: no rows.
    """
    both = checkpointed(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct()
    )
    labels = checkpointed(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    )
    while True:
        near = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        )
        moved = labels.join(near, labels.node == near.a).select(
            "node", "label", F.least("label", "near").alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        after = checkpointed(
            moved.join(jump, "low", "left").select(
                "node", F.least("low", "next").alias("label"),
                (F.least("low", "next") != F.col("label")).alias("changed"),
            )
        )
        labels = after.select("node", "label")
        if not after.where("changed").take(1):
            return labels
