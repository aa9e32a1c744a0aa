"""Exact ranks and prefix sums that never sort a whole group in one task.

A group is cut into buckets that respect the order (leading hash digits, or
value ranges). Ranks inside a bucket come from a window on (group, bucket); the
offset of a bucket comes from a window over the bucket totals, of which there
are few. The result equals ``row_number()`` over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rewardloom.functions.let import let

HASH_DIGITS = 4
VALUE_BUCKETS = 1024
FANOUT = 32


def sample_key(seed: int, *keys: str) -> Column:
    """Order of a seeded shuffle: MD5 of the seed and the row's key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def _rank(df: DataFrame, groups: list[str], order: list[Column], rank: str, size: str,
          limit: int | None = None) -> DataFrame:
    """With ``limit`` only the buckets that hold the first ranks are sorted."""
    totals = df.groupBy(*groups, "_bucket").agg(F.count("*").alias("_rows"))
    if groups:
        whole = W.partitionBy(*groups)
    else:
        whole = W.partitionBy(F.lit(0))
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_bucket",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias(size),
    )
    inside = W.partitionBy(*groups, "_bucket").orderBy(*order)
    if limit is None:
        placed = df.withColumn("_inner", F.row_number().over(inside)).join(offsets, [*groups, "_bucket"])
    else:
        first = df.join(offsets.where(F.col("_offset") < limit), [*groups, "_bucket"])
        placed = first.withColumn("_inner", F.row_number().over(inside))
    ranked = placed.withColumn(rank, F.col("_offset") + F.col("_inner")).drop("_bucket", "_inner", "_offset")
    return ranked if limit is None else ranked.where(F.col(rank) <= limit)


def shuffled_rank(df: DataFrame, groups: list[str], keys: list[str], seed: int = 42,
                  rank: str = "rank", size: str = "group_size", limit: int | None = None) -> DataFrame:
    """1-based rank in a seeded shuffle of each group, plus the group size.

    MD5 digits are uniform, so buckets stay even when one group dominates. With
    ``limit`` only the first ranks are returned.
    """
    keyed = df.withColumn("_key", sample_key(seed, *keys))
    keyed = keyed.withColumn("_bucket", F.substr("_key", F.lit(1), F.lit(HASH_DIGITS)))
    order = [F.col("_key"), *[F.col(k) for k in keys]]
    return _rank(keyed, groups, order, rank, size, limit).drop("_key")


def value_edges(df: DataFrame, column: str, buckets: int = VALUE_BUCKETS) -> list[float]:
    """Inner quantile edges of a numeric column: at most ``buckets - 1`` numbers.

    Computed once, so that every branch of a plan cuts at the same values.
    Global quantiles bound each (group, bucket) by the rows between two edges.
    """
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = df.stat.approxQuantile(column, probabilities, 1.0 / (4 * buckets))
    return sorted(set(edges))


def value_bucket(column: Column, edges: list[float]) -> Column:
    """Number of edges at or below a value, found in two short steps."""
    if not edges:
        return F.lit(0)
    groups = [edges[i:i + FANOUT] for i in range(0, len(edges), FANOUT)]

    def numbers(values: list[float]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def at_or_below(values: Column, x: Column) -> Column:
        return F.size(F.filter(values, lambda edge: edge <= x))

    coarse, fine = numbers([g[0] for g in groups]), F.array(*[numbers(g) for g in groups])

    def locate(x: Column) -> Column:
        return let(at_or_below(coarse, x), lambda g: F.when(g == 0, 0).otherwise(
            (g - 1) * FANOUT + at_or_below(F.get(fine, g - 1), x)))

    return let(column, locate)


def ordered_rank(df: DataFrame, groups: list[str], column: str, ties: list[str] | None = None,
                 rank: str = "rank", size: str = "group_size", limit: int | None = None) -> DataFrame:
    """1-based rank by a numeric column inside each group, plus the group size."""
    edges = value_edges(df, column)
    bucketed = df.withColumn("_bucket", value_bucket(F.col(column), edges))
    order = [F.col(column), *[F.col(t) for t in ties or []]]
    return _rank(bucketed, groups, order, rank, size, limit)


def first_rows(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group, for a small ``k``: a task passes on at most ``k`` rows of a group."""
    window = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k).drop("_n")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order, by aggregation with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.count("*").alias("copies")
    )
    return picked.select(*keys, "_row.*", "copies")
