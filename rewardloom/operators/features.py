"""Answer features and consensus, by aggregation and a join on the group key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.numeric import log_scaled, numeric_answer
from rewardloom.functions.vectors import fit_length


def consensus(df: DataFrame, keys: list[str], answer: str = "answer", order: str = "resp_idx") -> DataFrame:
    """Most frequent rounded answer per group; ties go to the first met.

    Two aggregations with map-side combine, so a dominant group costs no task
    more than its distinct answers.
    """
    counted = (
        df.withColumn("_rounded", F.round(answer, 2))
        .groupBy(*keys, "_rounded")
        .agg(F.count("*").alias("_votes"), F.min(order).alias("_first"))
    )
    known = F.col("_rounded").isNotNull()
    rank = F.when(known, F.struct(F.col("_votes"), -F.col("_first")))
    return counted.groupBy(*keys).agg(
        F.max_by("_rounded", rank).alias("consensus"),
        F.max(rank)["_votes"].alias("support"),
        F.sum("_votes").alias("n"),
        F.coalesce(F.sum(F.when(known, F.col("_votes"))), F.lit(0)).alias("n_valid"),
    )


def matches_consensus(answer: Column, agreed: Column, strict_zero: bool = False) -> Column:
    """A consensus of zero counts as no consensus unless ``strict_zero``."""
    usable = agreed.isNotNull() if strict_zero else agreed.isNotNull() & (agreed != 0)
    return usable & (F.abs(F.round(answer, 2) - agreed) < 0.01)


def feature_vector(answer: Column, agreed: Column, domain: Column, strict_zero: bool = False) -> Column:
    """``[scaled value, valid, agrees]``; zeros where there is no number."""
    agrees = F.when(matches_consensus(answer, agreed, strict_zero), 1.0).otherwise(0.0)
    known = F.array(log_scaled(answer), F.lit(1.0), agrees)
    return F.when((domain == "math") & answer.isNotNull(), known).otherwise(empty_features())


def empty_features(length: int = 3) -> Column:
    return F.array(*[F.lit(0.0)] * length)


def answer_features(rollouts: DataFrame, keys: list[str], domain: Column, strict_zero: bool = False) -> DataFrame:
    """Rollouts with ``answer``, ``consensus`` and ``answer_features``."""
    parsed = rollouts.withColumn("_domain", domain).withColumn(
        "answer", F.when(F.col("_domain") == "math", numeric_answer(F.col("response")))
    )
    agreed = consensus(parsed, keys).select(*keys, "consensus")
    return (
        parsed.join(agreed, keys)
        .withColumn("answer_features",
                    feature_vector(F.col("answer"), F.col("consensus"), F.col("_domain"), strict_zero))
        .drop("_domain")
    )


def align_features(df: DataFrame, column: str = "answer_features") -> DataFrame:
    """Pads every vector to the longest in the table."""
    longest = df.agg(F.max(F.size(column))).scalar()
    return df.withColumn(column, fit_length(F.col(column), longest))


def self_consistency(rollouts: DataFrame, keys: list[str]) -> DataFrame:
    """Consensus, support, agreement and valid rate per group."""
    report = consensus(rollouts.withColumn("answer", numeric_answer(F.col("response"))), keys)
    return report.select(
        *keys, "consensus", F.coalesce("support", F.lit(0)).alias("support"), "n",
        (F.coalesce("support", F.lit(0)) / F.col("n")).alias("agreement"),
        (F.col("n_valid") / F.col("n")).alias("valid_rate"),
    )
