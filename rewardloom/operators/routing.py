"""Which queries are scored with ground truth and which along the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.domains import dataset_name, normalise_source, query_identifier, route_family
from rewardloom.functions.text import present
from rewardloom.operators.ranking import ordered_rank


def parse_extra(extra: Column) -> Column:
    """JSON text to a string map; null or malformed text gives an empty map."""
    return F.coalesce(F.from_json(extra, "map<string,string>"), F.expr("map()").cast("map<string,string>"))


def entry(extra: Column, key: str) -> Column:
    return F.try_element_at(extra, F.lit(key))


def answer_or(extra: Column, truth: Column) -> Column:
    """Only a missing answer falls through; an empty one does not."""
    return F.when(F.map_contains_key(extra, F.lit("answer")), entry(extra, "answer")).otherwise(truth)


def is_train(extra: Column) -> Column:
    return F.coalesce(entry(extra, "is_train").try_cast("boolean"), F.lit(True))


def prompt_key(extra: Column, source: Column, position: Column) -> Column:
    """Question, else prompt, else source and id."""
    number = F.coalesce(entry(extra, "index"), entry(extra, "task_id"), position.cast("string"))
    return F.coalesce(
        present(entry(extra, "question")), present(entry(extra, "prompt")), F.concat_ws("_", source, number)
    )


def identified(df: DataFrame, extra: Column, source: str = "data_source") -> DataFrame:
    """Adds ``dataset``, ``identifier`` and ``family``, the routing join key."""
    return df.withColumns({
        "dataset": dataset_name(F.col(source)),
        "identifier": query_identifier(F.col(source), entry(extra, "index"), entry(extra, "problem_id")),
        "family": route_family(F.col(source)),
    })


def in_gt(df: DataFrame, gt_ids: DataFrame, keys: list[str]) -> DataFrame:
    """Semi join. Spark broadcasts the ids only when their measured size allows."""
    return df.join(gt_ids.select(*keys).distinct(), keys, "left_semi")


def not_in_gt(df: DataFrame, gt_ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gt_ids.select(*keys).distinct(), keys, "left_anti")


def with_gt_flag(df: DataFrame, gt_ids: DataFrame, keys: list[str], flag: str = "in_gt") -> DataFrame:
    marked = gt_ids.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def validation_batches(df: DataFrame, batch: str, train: str = "is_train") -> DataFrame:
    """Batches with any row outside training; they are scored with ground truth."""
    return df.where(~F.coalesce(F.col(train), F.lit(True))).select(batch).distinct()


def gate_batches(df: DataFrame, batch: str, train: str = "is_train", rows: DataFrame | None = None) -> DataFrame:
    """Flags validation batches, found in ``rows`` where ``df`` was made from them at some cost."""
    gated = validation_batches(df if rows is None else rows, batch, train).withColumn("validation", F.lit(True))
    return df.join(gated, batch, "left").withColumn("validation", F.coalesce("validation", F.lit(False)))


def route_prompts(df: DataFrame, gt_ids: DataFrame, keys: list[str], order: str,
                  reference_families: bool = True) -> DataFrame:
    """One row per prompt group: does its first item use ground truth?

    Rows carry ``data_source``, ``index`` and ``problem_id`` as text. Equal fields
    of a group are merged by a hash aggregate first, so a prompt with very many
    rollouts reaches the second step as a few rows; names are only then resolved.
    With ``reference_families=False`` every listed data set can match, which also
    routes the sets that the published family lists leave out.
    """
    raw = ["data_source", "index", "problem_id"]
    merged = df.groupBy(*keys, *raw).agg(F.min(order).alias("_first"), F.count("*").alias("_n"))
    first = merged.groupBy(*keys).agg(
        F.min_by(F.struct(*raw), "_first").alias("first"), F.sum("_n").alias("items"),
    ).select(*keys, "items", "first.*")
    named = first.withColumns({
        "dataset": dataset_name(F.col("data_source")),
        "identifier": query_identifier(F.col("data_source"), F.col("index"), F.col("problem_id")),
        "family": route_family(F.col("data_source")),
    })
    flagged = with_gt_flag(named, gt_ids, ["dataset", "identifier"])
    use = F.col("in_gt")
    if reference_families:
        use = use & F.col("family").isNotNull()
    return flagged.withColumn("use_gt", use).drop("in_gt", "index", "problem_id")


def routing_stats(df: DataFrame, use_gt: Column) -> DataFrame:
    """Counts and shares of the two routes."""
    counts = df.agg(F.count_if(use_gt).alias("gt_count"), F.count_if(~use_gt).alias("gnn_count"))
    total = F.col("gt_count") + F.col("gnn_count")
    return counts.select(
        "gt_count", "gnn_count",
        F.when(total > 0, F.col("gt_count") / total * 100).alias("gt_percentage"),
        F.when(total > 0, F.col("gnn_count") / total * 100).alias("gnn_percentage"),
    )


def gt_identifiers(positions: DataFrame, limits: DataFrame, group: str = "dataset", key: str = "index",
                   position: str = "pos") -> DataFrame:
    """The first ids of each data set in order of appearance, one row per id.

    ``limits`` holds ``n_parquet`` and ``n_cache`` per data set; as many ids are
    taken as the smaller of the two.
    """
    seen = positions.groupBy(group, key).agg(F.min(position).alias("first_pos"))
    ranked = ordered_rank(seen, [group], "first_pos")
    return ranked.join(limits, group).where(
        F.col("rank") <= F.least("n_parquet", "n_cache")
    ).select(group, key, "rank", F.col("group_size").alias("n_unique"), "n_parquet", "n_cache")


def gt_coverage(ids: DataFrame, group: str = "dataset") -> DataFrame:
    return ids.groupBy(group).agg(
        F.count("*").alias("n_total"),
        F.round(F.count("*") / F.max("n_parquet") * 100, 6).alias("coverage"),
    )


def training_modes(df: DataFrame, gt_ids: DataFrame, keys: list[str]) -> DataFrame:
    """Every row once per mode it belongs to: full, partial_gt, mix.

    One pass: the id join gives a flag, and the flag decides the exploded modes.
    """
    flagged = with_gt_flag(df, gt_ids, keys, "is_gt")
    modes = F.when(F.col("is_gt"), F.array(F.lit("full"), F.lit("partial_gt"), F.lit("mix"))).otherwise(
        F.array(F.lit("full"), F.lit("mix"))
    )
    return flagged.withColumn("mode", F.explode(modes))


def mode_statistics(modes: DataFrame, source: str) -> DataFrame:
    counts = modes.groupBy("mode", source).agg(F.count("*").alias("rows"))
    full = counts.where(F.col("mode") == "full").select(source, F.col("rows").alias("full_rows"))
    return counts.join(full, source).select(
        "mode", source, "rows", F.round(F.col("rows") / F.col("full_rows") * 100, 6).alias("kept_percent")
    )


def relative_index(df: DataFrame, group: str, offsets: DataFrame, index: str = "global_index") -> DataFrame:
    """Index inside its own data set, from per-data-set offsets."""
    return df.join(offsets, group).withColumn("relative_index", F.col(index) - F.col("offset"))


def storage_source(df: DataFrame, source: str = "data_source") -> DataFrame:
    return df.withColumn(source, normalise_source(F.col(source)))
