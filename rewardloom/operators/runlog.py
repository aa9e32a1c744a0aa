"""Training logs: scores per step, best step, early stopping, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rewardloom.functions.text import log_scores, log_step


def parse_log(lines: DataFrame, order: str, files: list[str] | None = None,
              known: list[str] | None = None) -> DataFrame:
    """Long ``(step, dataset, score)``; for a repeated step the last line wins."""
    keys = files or []
    parsed = lines.select(
        *keys, order, log_step(F.col("line")).alias("step"), log_scores(F.col("line")).alias("scores")
    ).where(F.col("step").isNotNull())
    if known is not None:
        parsed = parsed.withColumn("scores", F.filter("scores", lambda s: s["dataset"].isin(known)))
    parsed = parsed.where(F.size("scores") > 0)
    last = parsed.groupBy(*keys, "step").agg(F.max_by("scores", F.col(order)).alias("scores"))
    # Within a line a later score of the same data set replaces an earlier one.
    pairs = last.select(*keys, "step", F.posexplode("scores").alias("at", "s"))
    return pairs.groupBy(*keys, "step", F.col("s.dataset").alias("dataset")).agg(
        F.max_by("s.score", F.col("at")).alias("score")
    )


def best_steps(averages: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Marks steps that beat all earlier ones, and the earliest best step.

    Input is one row per step, so the window covers step counts, not log lines.
    """
    keys = runs or []
    scope = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = scope.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    so_far = F.max("avg_score").over(earlier)
    best = F.max_by("step", F.struct(F.col("avg_score"), -F.col("step"))).over(scope)
    return averages.withColumns({
        "improves": so_far.isNull() | (F.col("avg_score") > so_far),
        "is_best": F.col("step") == best,
    })


def best_step(averages: DataFrame, runs: list[str] | None = None) -> DataFrame:
    order = F.struct(F.col("avg_score"), -F.col("step"))
    return averages.groupBy(*(runs or [])).agg(
        F.max_by("step", order).alias("best_step"), F.max("avg_score").alias("best_score")
    )


def early_stopping(history: DataFrame, run: str, patience: int) -> DataFrame:
    """Best epoch and last epoch of each run under patience-based stopping.

    Input is one row per (run, epoch). An epoch improves when it beats zero and
    every earlier epoch; training stops once ``patience`` epochs bring nothing.
    """
    scope = W.partitionBy(run).orderBy("epoch")
    earlier = scope.rowsBetween(W.unboundedPreceding, -1)
    up_to_now = scope.rowsBetween(W.unboundedPreceding, 0)
    so_far = F.greatest(F.coalesce(F.max("metric").over(earlier), F.lit(0.0)), F.lit(0.0))
    marked = history.withColumn("improved", F.col("metric") > so_far).withColumn(
        "place", F.row_number().over(scope)
    )
    last_gain = F.coalesce(F.max(F.when(F.col("improved"), F.col("place"))).over(up_to_now), F.lit(0))
    marked = marked.withColumn("idle", F.col("place") - last_gain)
    stop = marked.groupBy(run).agg(
        F.coalesce(F.min(F.when(F.col("idle") >= patience, F.col("place"))), F.max("place")).alias("stop_place")
    )
    seen = marked.join(stop, run).where(F.col("place") <= F.col("stop_place"))
    return seen.groupBy(run).agg(
        F.coalesce(F.max(F.when(F.col("improved"), F.col("epoch"))), F.lit(0)).alias("best_epoch"),
        F.coalesce(F.max(F.when(F.col("improved"), F.col("metric"))), F.lit(0.0)).alias("best_metric"),
        F.max("epoch").alias("total_epochs"),
    )


def match_checkpoints(log_steps: DataFrame, checkpoint_steps: DataFrame, log: str = "log",
                      recency: str | None = None) -> DataFrame:
    """Overlap of each log with the saved steps; the best one covers half or more."""
    saved = checkpoint_steps.select("step").distinct()
    needed = saved.agg(F.count("*").alias("n_saved"))
    overlap = log_steps.select(log, "step").distinct().join(saved, "step").groupBy(log).agg(
        F.count("*").alias("overlap")
    )
    scored = overlap.withColumn("n_saved", needed.scalar())
    fits = F.col("overlap") >= F.col("n_saved") * 0.5
    order = F.when(fits, F.struct(F.col("overlap"), -F.col(recency or log)))
    best = scored.agg(F.max_by(F.col(log), order).alias("best"))
    return scored.withColumn("is_best", F.coalesce(F.col(log) == best.scalar(), F.lit(False)))
