"""Seeded samples, splits and nested subsets, all cut from one hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rewardloom.operators.ranking import first_per_key, ordered_rank, shuffled_rank


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; ``copies`` counts the rows it stands for."""
    return first_per_key(df, keys, order)


def sample_per_group(df: DataFrame, groups: list[str], keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` random rows per group, or all where there are fewer.

    Bucket totals tell which hash buckets can hold the sample; the others are
    dropped before any sort, and no task meets a whole group.
    """
    return shuffled_rank(df, groups, keys, seed, "_n", "_size", limit=size).drop("_n", "_size")


def _label(rank: Column, train_end: Column, valid_end: Column) -> Column:
    return (
        F.when(rank <= train_end, "train").when(rank <= valid_end, "valid").otherwise("test")
    )


def split_by_share(df: DataFrame, groups: list[str], keys: list[str], train: float = 0.5,
                   valid: float = 0.2, seed: int = 42) -> DataFrame:
    """Shares rounded down, remainder to test."""
    ranked = shuffled_rank(df, groups, keys, seed)
    train_end = F.floor(F.col("group_size") * train)
    valid_end = train_end + F.floor(F.col("group_size") * valid)
    return ranked.withColumn("split", _label(F.col("rank"), train_end, valid_end))


def split_by_count(df: DataFrame, groups: list[str], keys: list[str], train: int, valid: int,
                   test: int, seed: int = 42) -> DataFrame:
    """Fixed sizes. Short groups shrink all three by the same ratio, rounded down.

    What rounding leaves over goes to test; rows beyond the three sizes belong to
    no split.
    """
    ranked = shuffled_rank(df, groups, keys, seed)
    wanted = train + valid + test
    short = F.col("group_size") < wanted
    train_end = F.when(short, F.floor(F.col("group_size") * train / wanted)).otherwise(train)
    valid_size = F.when(short, F.floor(F.col("group_size") * valid / wanted)).otherwise(valid)
    labelled = ranked.withColumn("split", _label(F.col("rank"), train_end, train_end + valid_size))
    return labelled.where(short | (F.col("rank") <= wanted))


def nested_subsets(df: DataFrame, groups: list[str], keys: list[str], percents: list[int],
                   seed: int = 42, floor_one: bool = True) -> DataFrame:
    """One row per (row, percent) that contains it. Smaller subsets nest in larger."""
    ranked = shuffled_rank(df, groups, keys, seed)
    size = F.floor(F.col("group_size") * F.col("percent") / 100)
    if floor_one:
        size = F.greatest(F.lit(1), size)
    return ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))).where(
        F.col("rank") <= size
    )


def tenth(df: DataFrame, groups: list[str], keys: list[str], seed: int = 42) -> DataFrame:
    """Ten percent per group, rounded to the nearest row."""
    ranked = shuffled_rank(df, groups, keys, seed)
    return ranked.where(F.col("rank") <= F.round(F.col("group_size") * 0.1))


def first_k(df: DataFrame, groups: list[str], position: str, k: int) -> DataFrame:
    """First ``k`` rows per group by a numeric position; value buckets past them are never sorted."""
    return ordered_rank(df, groups, position, rank="_n", size="_size", limit=k).drop("_n", "_size")


def prefix_to_match(df: DataFrame, other: DataFrame, groups: list[str], position: str) -> DataFrame:
    """Per group, the prefix as long as the other table's group (at most)."""
    limits = other.groupBy(*groups).agg(F.count("*").alias("_limit"))
    return (
        ordered_rank(df, groups, position)
        .join(limits, groups)
        .where(F.col("rank") <= F.least("_limit", "group_size"))
        .drop("_limit")
    )


def split_summary(df: DataFrame, group: str) -> DataFrame:
    """Rows per split and group, with a TOTAL row."""
    counts = df.groupBy(group, "split").agg(F.count("*").alias("n"))
    scope = counts.withColumn("scope", F.explode(F.array(F.col(group), F.lit("TOTAL"))))
    return (
        scope.groupBy("scope").pivot("split", ["train", "valid", "test"]).agg(F.sum("n"))
        .select("scope", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in ("train", "valid", "test")])
        .withColumn("sampled", F.col("train") + F.col("valid") + F.col("test"))
    )


def global_index(df: DataFrame, dataset_rank: str, position: str) -> DataFrame:
    """Sequential index over datasets in order, with no single-partition sort."""
    ranked = ordered_rank(df, [dataset_rank], position)
    sizes = df.groupBy(dataset_rank).agg(F.count("*").alias("_n"))
    before = W.partitionBy(F.lit(0)).orderBy(dataset_rank).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(dataset_rank, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    return ranked.join(offsets, dataset_rank).withColumn(
        "global_index", F.col("offset") + F.col("rank") - 1
    )
