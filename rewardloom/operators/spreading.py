"""Label spreading to a fixed point over query, think and answer edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.session import cut_lineage


def incoming_shares(edges: DataFrame) -> DataFrame:
    """``src, dst, share``: an edge's part of what its target hears, parallel edges added up.

    Edges of no or negative weight say nothing.
    """
    kept = edges.where(F.col("weight") > 0).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    totals = kept.groupBy("dst").agg(F.sum("weight").alias("total"))
    return kept.join(totals, "dst").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def spread_rewards(nodes: DataFrame, edges: DataFrame, damping: float = 0.5, prior: float = 0.5,
                   tolerance: float = 1e-9, most: int = 500) -> tuple[DataFrame, int, float]:
    """``id, reward, value`` of all nodes at the fixed point, the rounds taken and the last change.

    ``nodes`` are (id, reward); a reward that is not null is clamped. Any other node
    takes ``(1 - damping) * prior + damping *`` the weighted mean of its neighbours,
    until no value moves by more than ``tolerance``; the damping below one makes the
    map a contraction, so that the rounds are bounded whatever the graph is like. A
    node without incoming edges keeps the prior.

    A round is one join and one aggregate with map-side sums, over a table of two
    numbers a node; only the greatest change reaches the driver. What labelled nodes
    send never changes and is summed once, so that rounds move unlabelled values only.
    """
    if not 0 <= damping < 1:
        raise ValueError("damping must be from 0 to below 1")
    shares = incoming_shares(edges)
    fixed = nodes.where(F.col("reward").isNotNull()).select("id", F.col("reward").cast("double").alias("value"))
    free = nodes.where(F.col("reward").isNull()).select("id")
    heard = cut_lineage(shares.join(free.withColumnRenamed("id", "dst"), "dst", "left_semi"), "shares")
    said = heard.join(fixed.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
        F.sum(F.col("share") * F.col("value")).alias("given"))
    deaf = heard.select(F.col("dst").alias("id")).distinct().withColumn("hears", F.lit(True))
    base = cut_lineage(free.join(said, "id", "left").join(deaf, "id", "left").select(
        "id", F.coalesce("hears", F.lit(False)).alias("hears"), F.coalesce("given", F.lit(0.0)).alias("given")), "base")
    inner = cut_lineage(heard.join(free.withColumnRenamed("id", "src"), "src", "left_semi").repartition("src"), "inner")
    state = base.select("id", F.lit(float(prior)).alias("value"))
    rounds, change = 0, float("inf")
    while rounds < most and change > tolerance:
        sums = inner.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("share") * F.col("value")).alias("moved"))
        mean = F.col("given") + F.coalesce("moved", F.lit(0.0))
        fresh = F.when(F.col("hears"), (1 - damping) * prior + damping * mean).otherwise(F.lit(float(prior)))
        moved = base.join(sums, "id", "left").join(state.withColumnRenamed("value", "old"), "id").select(
            "id", fresh.alias("value"), "old")
        moved = cut_lineage(moved, "spread")
        change = moved.agg(F.coalesce(F.max(F.abs(F.col("value") - F.col("old"))), F.lit(0.0))).head()[0]
        state, rounds = moved.select("id", "value"), rounds + 1
    every = fixed.select("id", F.col("value").alias("reward"), "value").unionByName(
        state.select("id", F.lit(None).cast("double").alias("reward"), "value"))
    return every, rounds, change
