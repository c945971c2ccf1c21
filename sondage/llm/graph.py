"""Connected components as distributed label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.common import spool


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). Result: node, component (least node it reaches). Nothing but counts reaches the driver.

    Each round takes the least label of the neighbours (combined map-side, so a hub is no hot spot) and then the
    label of that label; every round is written to the shared folder, which cuts lineage. Stars, chains of hubs and
    cliques need a few rounds, a path of n nodes O(log n) to O(n) at worst.
    """
    both = spool(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = spool(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = spool(low.join(up, "label").select("node", "old", F.least("label", "top").alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
