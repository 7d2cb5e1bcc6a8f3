"""Connected components of a link table, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``: label is the smallest node reachable.

    Each round takes the least label among a node's neighbours (a sum-like aggregation that combines
    before its shuffle, so hubs cost a row per map task) and then follows labels once, which shortens
    chains geometrically. Both tables of a join come straight from files, so a hub's links can be split
    over tasks. Every round is written to the shared folder; the previous one is deleted.
    """
    both = materialize(
        links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        least = materialize(near.union(labels).groupBy("node").agg(F.min("label").alias("label")), "labels")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nearer = materialize(least.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        release(least)
        total = [x.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0] for x in (labels, nearer)]
        release(labels)
        labels = nearer
        if total[0] == total[1]:
            release(both)
            return labels
