"""Data checks: counts of violations and set comparisons, all as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.text import brace_balance


def unbalanced(df: DataFrame, column: str) -> DataFrame:
    """Rows whose braces do not pair up by count."""
    return df.where(brace_balance(F.col(column)) != 0)


def require_balanced(df: DataFrame, column: str) -> DataFrame:
    """The rows unchanged; the job fails at the first unbalanced one."""
    message = F.concat(F.lit("unbalanced braces: "), F.col(column))
    failing = F.when(brace_balance(F.col(column)) == 0, F.col(column)).otherwise(
        F.raise_error(message).cast("string")
    )
    return df.withColumn(column, failing)


def short_prompts(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Prompts of at most ``limit`` words; longer ones are filtered out whole."""
    return df.where(F.size(F.split(F.col(column), r"\s+", -1)) <= limit)


def current_sources(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows of the sources still in use.

    Names need the prefix and must not be validation, backup or unified copies.
    ``X`` is superseded where ``X_train`` exists.
    """
    col = F.col(name)
    kept = df.where(
        col.startswith(prefix) & ~F.contains(col, F.lit("_valid")) & ~F.contains(col, F.lit("_backup"))
        & ~F.contains(col, F.lit("unified"))
    )
    newer = kept.where(col.endswith("_train")).select(
        F.regexp_replace(col, "_train$", "").alias(name)
    ).distinct()
    return kept.join(newer, name, "left_anti")


def wrong_group_sizes(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Groups that do not hold exactly ``size`` rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") != size)


def leaked(memory: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """Memory rows whose key also appears in a held-out split."""
    return memory.join(held_out.select(*keys).distinct(), keys, "left_semi")


def leak_report(memory: DataFrame, held_out: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Memory size against its limit, and the number of leaked rows."""
    marked = memory.join(
        held_out.select(*keys).distinct().withColumn("_held", F.lit(1)), keys, "left"
    )
    return marked.agg(F.count("*").alias("n_memory"), F.count("_held").alias("n_leaked")).select(
        "n_memory", F.lit(limit).cast("bigint").alias("limit"), "n_leaked",
        ((F.col("n_memory") <= limit) & (F.col("n_leaked") == 0)).alias("ok"),
    )


def align_sources(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Presence flags of every key across tables.

    Tags each table and aggregates once; equal to chained full outer joins but
    with a single shuffle and map-side combine.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [df.select(*keys, F.lit(name).alias("_table")) for name, df in tables.items()],
    )
    return tagged.groupBy(*keys).agg(
        *[F.bool_or(F.col("_table") == name).alias(f"in_{name}") for name in tables]
    )


def difference_counts(aligned: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """Keys on one side only, and on both, per group."""
    a, b = F.col(f"in_{left}"), F.col(f"in_{right}")
    return aligned.groupBy(group).agg(
        F.count_if(a & ~b).alias("left_only"), F.count_if(~a & b).alias("right_only"),
        F.count_if(a & b).alias("both"),
    )


def aligned_groups(aligned: DataFrame, group: str, names: list[str]) -> DataFrame:
    """True where all tables hold the same non-empty key set."""
    flags = [F.col(f"in_{n}") for n in names]
    return aligned.groupBy(group).agg(
        F.bool_and(reduce(lambda x, y: x & y, flags)).alias("aligned"), F.count("*").alias("n_keys")
    )


def verdict(groups: DataFrame, flag: str = "aligned") -> DataFrame:
    return groups.agg(F.bool_and(F.col(flag)).alias("all_ok"), F.count("*").alias("groups"))


def flag_consistency(df: DataFrame, split: str, flag: Column, expected: Column) -> DataFrame:
    """Rows whose training flag contradicts their split."""
    wrong = ~flag.eqNullSafe(expected)
    return df.groupBy(split).agg(
        F.count_if(wrong).alias("wrong"), F.count("*").alias("total")
    ).withColumn("consistent", F.col("wrong") == 0)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and two order-free hashes over all columns."""
    cols = sorted(df.columns)
    digest = F.xxhash64(*cols)
    return df.agg(
        F.count("*").alias("rows"),
        F.bit_xor(digest).alias("hash_xor"),
        F.sum(digest.cast("decimal(38,0)")).alias("hash_sum"),
    )


def matches_manifest(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Does a table carry the fingerprint that was recorded for it?"""
    return table_fingerprint(df).join(
        manifest.withColumn("recorded", F.lit(True)), ["rows", "hash_xor", "hash_sum"], "left"
    ).select("rows", F.coalesce("recorded", F.lit(False)).alias("matches"))
