"""Test outcomes that arrive on a stream of their own, joined to the rollouts they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_rewards(rollouts: DataFrame, outcomes: DataFrame, keys: list[str], timeout: str = "10 minutes",
                    delay: str = "10 minutes") -> DataFrame:
    """Reward of each rollout from its test outcome: ``keys, ts, reward, outcome_ts``.

    ``rollouts`` (keys, ts) and ``outcomes`` (keys, ts, passed) are streams or tables.
    An outcome counts if its time lies from the rollout's to ``timeout`` after it; 1
    if all tests passed, else 0. Without one the reward is 0, and is given once the
    watermark, ``delay`` behind the latest time seen on both sides, has passed the
    timeout. Of several outcomes of a rollout one counts, that of the smallest
    time in a table and the first to arrive on a stream. Rows later than the watermark
    are left out: a late outcome makes no reward, a late rollout has none. Both sides'
    rows leave the state when the watermark has passed them; nulls in the keys meet nothing.
    """
    left = rollouts.select(*keys, "ts").withWatermark("ts", delay)
    right = outcomes.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("ts").alias("outcome_ts"), "passed")
    names = [f"o_{k}" for k in keys]
    if outcomes.isStreaming:
        right = right.withWatermark("outcome_ts", delay).dropDuplicatesWithinWatermark(names)
    else:
        right = right.groupBy(*names).agg(
            F.min_by("passed", "outcome_ts").alias("passed"), F.min("outcome_ts").alias("outcome_ts"))
    same = [F.col(k) == F.col(f"o_{k}") for k in keys]
    inside = (F.col("outcome_ts") >= F.col("ts")) & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"INTERVAL {timeout}"))
    condition = inside
    for equal in same:
        condition = condition & equal
    joined = left.join(right, condition, "leftOuter")
    reward = F.when(F.coalesce(F.col("passed"), F.lit(False)), 1.0).otherwise(0.0)
    return joined.select(*keys, "ts", reward.alias("reward"), "outcome_ts")
