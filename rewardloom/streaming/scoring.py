"""Scoring jobs over rollout streams. They reuse the batch transforms unchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rewardloom.config import EngineConfig
from rewardloom.functions.domains import scoring_domain
from rewardloom.operators.scoring import score_gt
from rewardloom.plans.mixed_reward import GraphMemory, KeyedVectors, MemorySearch, mixed_reward
from rewardloom.session import cut_lineage, scratch_folder, shared_folder


def score_stream(rollouts: DataFrame) -> DataFrame:
    """Ground-truth rewards of a rollout stream; stateless."""
    return score_gt(rollouts, scoring_domain(F.col("data_source")), F.col("ground_truth"))


def route_counters(rollouts: DataFrame, use_gt: Column) -> DataFrame:
    """Running number of rollouts per reward source."""
    source = F.when(use_gt, "gt").otherwise("graph")
    return rollouts.groupBy(source.alias("reward_source")).agg(F.count("*").alias("n"))


def drop_redelivered(rollouts: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Each rollout once, with state kept no longer than the watermark."""
    return rollouts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def reward_rate(rollouts: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Reward rate per time window and source."""
    return (
        rollouts.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "source")
        .agg(F.count("*").alias("n"), F.avg("reward").alias("rate"))
        .select(F.col("w.start").alias("window_start"), "source", "n", "rate")
    )


def mixed_batches(gt_ids: DataFrame, vectors: DataFrame | KeyedVectors, folder: str, memory: GraphMemory,
                  config: EngineConfig = EngineConfig()) -> Callable[[DataFrame, int], None]:
    """A micro-batch function: mixed reward of one batch against static memory.

    With static memory a reward depends on the memory and on the rows of its own
    ``batch_id`` (gate, prompt, consensus). Those arrive together; then the result
    is the same however the stream is cut into micro-batches.

    Every batch writes its own folder in overwrite mode, so a batch repeated
    after a failure leaves no double rows. Its intermediate tables go with it.
    What all batches read of the static tables is made once, and a vector that an
    earlier batch has searched is not searched again.
    """
    ids, search = cut_lineage(gt_ids, "gt-ids"), MemorySearch(vectors, memory, config)

    def score(batch: DataFrame, batch_id: int) -> None:
        with scratch_folder(batch.sparkSession):
            rewards = mixed_reward(batch, ids, search.keyed, config, search)
            rewards.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return score


def _run(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    try:
        running.awaitTermination()
    finally:
        running.stop()


def new_folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def append_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drains a stream into parquet files in append mode and reads them back."""
    folder = new_folder(stream, name)
    _run(stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def latest_state(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drains an aggregating stream in update mode; the latest row of every key.

    A micro-batch writes only the groups that changed, and windows that the
    watermark has passed leave the state.
    """
    folder = new_folder(stream, name)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    _run(stream.writeStream.foreachBatch(put).outputMode("update")
         .option("checkpointLocation", f"{folder}/state"))
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("latest"))
    return latest.select(*keys, "latest.*")


def mixed_stream(rollouts: DataFrame, gt_ids: DataFrame, vectors: DataFrame | KeyedVectors, memory: GraphMemory, name: str = "mixed",
                 config: EngineConfig = EngineConfig()) -> DataFrame:
    """Drains a rollout stream through :func:`mixed_batches`."""
    folder = new_folder(rollouts, name)
    score = mixed_batches(gt_ids, vectors, f"{folder}/rows", memory, config)
    _run(rollouts.writeStream.foreachBatch(score).option("checkpointLocation", f"{folder}/state"))
    return rollouts.sparkSession.read.parquet(f"{folder}/rows").drop("batch")
