"""Writers for query tables, evaluation results and merged node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.sources.readers import existing_paths


def typed_reward_model(truth: Column) -> Column:
    """The explicit ``struct<ground_truth string>`` every query table carries."""
    return F.struct(truth.cast("string").alias("ground_truth"))


def write_queries(df: DataFrame, path: str, mode: str = "error") -> None:
    """Query table partitioned by dataset and split where those columns exist."""
    keys = [name for name in ("dataset", "split") if name in df.columns]
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def write_evaluation(details: DataFrame, summary: DataFrame, folder: str) -> None:
    """Details, correct rows only, summary as JSON, and a readable text table."""
    details.write.json(f"{folder}/details")
    details.where("correct").write.json(f"{folder}/correct")
    summary.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/summary")
    summary_lines(summary).write.text(f"{folder}/table")


def summary_lines(summary: DataFrame) -> DataFrame:
    """One formatted line per dataset of an already aggregated summary."""
    return summary.select(
        F.format_string(
            "%-20s: %d/%d = %.2f%%", F.col("dataset"), F.col("correct"), F.col("total"), F.col("accuracy")
        ).alias("value")
    )


def write_nodes(df: DataFrame, path: str, force: bool = False) -> bool:
    """Merged node table; kept as it is when present unless forced."""
    if not force and existing_paths(df.sparkSession, [f"{path}/_SUCCESS"]):
        return False
    df.write.mode("overwrite").partitionBy("domain").parquet(path)
    return True
