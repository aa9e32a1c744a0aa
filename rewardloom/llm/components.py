"""Connected components of a graph of edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, label`` for every node of ``edges`` (a, b): the smallest id it is connected to.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so that long chains halve. Rounds are written to the shared folder;
    only the count of changed labels reaches the driver. A hub's many neighbours
    meet in a partial aggregation, never in one group.
    """
    both = cut_lineage(edges.union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        lower = cut_lineage(lower, "labels")
        jump = lower.select(F.col("id").alias("next"), F.col("next").alias("far"))
        jumped = cut_lineage(
            lower.join(jump, "next", "left").select(
                "id", F.least("next", F.coalesce("far", "next")).alias("new"), "label"), "labels")
        changed = jumped.filter("new <> label").limit(1).count()
        labels = jumped.select("id", F.col("new").alias("label"))
        if not changed:
            return labels
