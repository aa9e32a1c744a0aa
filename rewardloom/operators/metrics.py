"""Classification, ranking and accuracy metrics, per data set and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rewardloom.functions.numeric import ratio
from rewardloom.operators.ranking import value_bucket, value_edges

OVERALL = "overall"


def label(reward: Column, threshold: float = 0.5) -> Column:
    """The library binarises at 0.5, the training script at 0."""
    return F.when(reward > threshold, 1).otherwise(0)


def confusion(prediction: Column, truth: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((prediction == 1) & (truth == 1)),
        "tn": F.count_if((prediction == 0) & (truth == 0)),
        "fp": F.count_if((prediction == 1) & (truth == 0)),
        "fn": F.count_if((prediction == 0) & (truth == 1)),
    }


def with_scopes(counts: DataFrame, group: str) -> DataFrame:
    """Each pre-aggregated row once for its own group and once for the total."""
    return counts.withColumn("scope", F.explode(F.array(F.col(group), F.lit(OVERALL))))


def confusion_counts(df: DataFrame, group: str, threshold: float = 0.5, label_threshold: float = 0.5) -> DataFrame:
    prediction = F.when(F.col("prob") > threshold, 1).otherwise(0)
    truth = label(F.col("reward"), label_threshold)
    counts = confusion(prediction, truth)
    per_group = df.groupBy(group).agg(
        *[value.alias(name) for name, value in counts.items()],
        F.sum("reward").alias("reward_sum"), F.count("*").alias("n"),
        F.sum(F.when(truth == 1, F.col("prob"))).alias("pos_score"),
        F.sum(F.when(truth == 0, F.col("prob"))).alias("neg_score"),
    )
    names = ["tp", "tn", "fp", "fn", "reward_sum", "n", "pos_score", "neg_score"]
    return with_scopes(per_group, group).groupBy("scope").agg(*[F.sum(c).alias(c) for c in names])


def classification(counts: DataFrame, raw_positive_rate: bool = False) -> DataFrame:
    """Rates from confusion counts; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    total = tp + tn + fp + fn
    rate = ratio(F.col("reward_sum"), F.col("n")) if raw_positive_rate else ratio(tp + fn, total)
    out = counts.withColumns({
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "accuracy": ratio(tp + tn, total),
        "fp_rate": ratio(fp, fp + tn),
        "fn_rate": ratio(fn, fn + tp),
        "positive_rate": rate,
    })
    p, r = F.col("precision"), F.col("recall")
    separation = F.when(
        (tp + fn > 0) & (fp + tn > 0), F.col("pos_score") / (tp + fn) - F.col("neg_score") / (fp + tn)
    ).otherwise(0.0)
    return out.withColumns({
        "f1": ratio(2 * p * r, p + r),
        "improvement": F.col("accuracy") - F.col("positive_rate"),
        "precision_delta": p - F.col("positive_rate"),
        "score_separation": separation,
    }).drop("reward_sum", "n", "pos_score", "neg_score")


def roc_auc(df: DataFrame, group: str, score: str = "prob", truth: Column | None = None) -> DataFrame:
    """Exact ROC-AUC with ties, per group and overall; 0.5 for a single class.

    Rows are first merged by equal score. Scores are then cut at global
    quantiles: a window inside (scope, bucket) counts pairs within a bucket, and
    bucket totals give the pairs across buckets. No task ever sorts a whole scope.
    """
    y = label(F.col("reward")) if truth is None else truth
    merged = df.groupBy(group, F.col(score).alias("score")).agg(
        F.sum(y).cast("double").alias("pos"), F.sum(1 - y).cast("double").alias("neg")
    )
    edges = value_edges(merged, "score")
    by_scope = with_scopes(merged, group).groupBy("scope", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    ).withColumn("bucket", value_bucket(F.col("score"), edges))
    inside = W.partitionBy("scope", "bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0.0))
    local = by_scope.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2)).groupBy("scope", "bucket").agg(
        F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    earlier = W.partitionBy("scope").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("neg").over(earlier), F.lit(0.0))
    whole = local.withColumn("wins", F.col("wins") + F.col("pos") * lower).groupBy("scope").agg(
        F.sum("wins").alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return whole.select("scope", ratio(F.col("wins"), F.col("pos") * F.col("neg"), 0.5).alias("roc_auc"))


def evaluate(df: DataFrame, group: str, threshold: float = 0.5, label_threshold: float = 0.5) -> DataFrame:
    """All metrics, one row per group and one overall."""
    rates = classification(confusion_counts(df, group, threshold, label_threshold))
    auc = roc_auc(df, group, truth=label(F.col("reward"), label_threshold))
    return rates.join(auc, "scope")


def positive_weight(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    y = label(F.col("reward"), threshold)
    counts = df.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    return counts.select("pos", "neg", ratio(F.col("neg"), F.col("pos"), 1.0).alias("pos_weight"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def weighted_bce(logit: Column, truth: Column, weight: Column) -> Column:
    """Mean weighted cross entropy from logits, in its stable form."""
    return F.avg(weight * truth * softplus(-logit) + (1 - truth) * softplus(logit))


def ranking_pairs(df: DataFrame, query: str, score: str, margin: float = 0.5) -> DataFrame:
    """Positive x negative pairs per query: count, wrongly ordered, hinge sum.

    No pair is ever produced. A positive at ``p`` costs ``m - p + n`` for every
    negative ``n > p - m``, so the positives of a query, shifted by the margin,
    and its negatives are put in one order, and suffix counts and sums of the
    negatives give the total. Wrong order (``n >= p``) is counted alike with the
    unshifted positives. Orders are cut at global quantiles as in ``roc_auc``.
    """
    positive = F.col("reward") > 0.5
    value = F.col(score)
    zero = F.lit(0.0)

    def event(kind: str, at: Column, n: Column, s: Column, p: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), at.alias("at"), n.alias("neg"), s.alias("neg_sum"), p.alias("pos")
        )

    one = F.lit(1.0)
    events = F.when(
        positive, F.array(event("hinge", value - margin, zero, zero, one), event("order", value, zero, zero, one))
    ).otherwise(
        F.array(event("hinge", value, one, value, zero), event("order", value, one, value, zero))
    )
    rows = df.select(F.col(query).alias("query_id"), F.explode(events).alias("e")).select("query_id", "e.*")
    merged = rows.groupBy("query_id", "kind", "at").agg(
        F.sum("neg").alias("neg"), F.sum("neg_sum").alias("neg_sum"), F.sum("pos").alias("pos")
    )
    edges = value_edges(rows, "at")
    merged = merged.withColumn("bucket", value_bucket(F.col("at"), edges))
    order = W.partitionBy("query_id", "kind", "bucket").orderBy(F.col("at").desc())
    above = order.rowsBetween(W.unboundedPreceding, -1)
    # Equal values: no hinge cost (strictly above), but wrong in order.
    upper = F.coalesce(F.sum("neg").over(above), zero)
    upper_sum = F.coalesce(F.sum("neg_sum").over(above), zero)
    ties = F.when(F.col("kind") == "order", F.col("neg")).otherwise(zero)
    local = merged.withColumns({
        "hits": F.col("pos") * (upper + ties),
        "cost": F.col("pos") * (upper_sum - F.col("at") * upper),
        "pos_at": F.col("pos") * F.col("at"),
    }).groupBy("query_id", "kind", "bucket").agg(
        *[F.sum(c).alias(c) for c in ("hits", "cost", "pos", "pos_at", "neg", "neg_sum")]
    )
    later = W.partitionBy("query_id", "kind").orderBy(F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, -1)
    n_later = F.coalesce(F.sum("neg").over(later), zero)
    s_later = F.coalesce(F.sum("neg_sum").over(later), zero)
    whole = local.withColumns({
        "hits": F.col("hits") + F.col("pos") * n_later,
        "cost": F.col("cost") + F.col("pos") * s_later - F.col("pos_at") * n_later,
    }).groupBy("query_id").agg(
        F.sum(F.when(F.col("kind") == "hinge", F.col("pos"))).alias("pos"),
        F.sum(F.when(F.col("kind") == "hinge", F.col("neg"))).alias("neg"),
        F.sum(F.when(F.col("kind") == "hinge", F.col("cost"))).alias("hinge_sum"),
        F.sum(F.when(F.col("kind") == "order", F.col("hits"))).alias("wrong"),
    )
    pairs = F.col("pos") * F.col("neg")
    return whole.where(pairs > 0).select(
        "query_id", pairs.cast("bigint").alias("pairs"), F.col("wrong").cast("bigint").alias("wrong_pairs"),
        "hinge_sum",
    )


def ranking_loss(df: DataFrame, query: str, score: str, margin: float = 0.5) -> DataFrame:
    pairs = ranking_pairs(df, query, score, margin)
    total = pairs.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.sum("hinge_sum").alias("s"))
    return total.select("pairs", ratio(F.col("s"), F.col("pairs")).alias("ranking_loss"))


def accuracy_report(details: DataFrame, group: str = "dataset") -> DataFrame:
    """Accuracy in percent and mean token counts, per data set and overall."""
    tokens = ["prompt_tokens", "completion_tokens", "total_tokens"]
    per_set = details.groupBy(group).agg(
        F.count_if("correct").alias("correct"), F.count("*").alias("total"),
        *[F.sum(t).alias(t) for t in tokens],
    )
    scoped = with_scopes(per_set, group).groupBy("scope").agg(
        *[F.sum(c).alias(c) for c in ("correct", "total", *tokens)]
    )
    return scoped.select(
        "scope", "correct", "total", F.round(100 * F.col("correct") / F.col("total"), 2).alias("accuracy"),
        *[F.round(F.col(t) / F.col("total"), 2).alias(f"avg_{t}") for t in tokens],
    )


def accuracy_summary(details: DataFrame, group: str = "dataset") -> DataFrame:
    per_set = details.groupBy(group).agg(F.count_if("correct").alias("correct"), F.count("*").alias("total"))
    return with_scopes(per_set, group).groupBy("scope").agg(
        F.sum("correct").alias("correct"), F.sum("total").alias("total")
    ).withColumn("accuracy", F.col("correct") / F.col("total") * 100)


def weighted_average(scores: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score weighted by data-set size; sets without a score count nowhere."""
    joined = scores.join(weights, "dataset")
    return joined.groupBy(*keys).agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("weighted_avg")
    )


def run_statistics(runs: DataFrame, column: str = "fp_rate") -> DataFrame:
    return runs.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )


def rank_runs(runs: DataFrame, column: str = "fp_rate", descending: bool = False) -> DataFrame:
    """Runs in order, lowest number first among equals, the best one marked."""
    value = F.col(column).desc() if descending else F.col(column).asc()
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(value, F.col("run")))
    return runs.withColumn("place", place).withColumn(
        "marker", F.when(F.col("place") == 1, "BEST").otherwise("")
    )


def best_rollout(df: DataFrame, query: str) -> DataFrame:
    """Best-of-N per query: the top rollout by probability, and pass@N."""
    return df.groupBy(query).agg(
        F.max_by("resp_idx", F.struct(F.col("prob"), -F.col("resp_idx"))).alias("best_resp"),
        F.max("prob").alias("best_prob"),
        F.max_by("reward", F.struct(F.col("prob"), -F.col("resp_idx"))).alias("best_reward"),
        F.bool_or(F.col("reward") > 0.5).alias("any_correct"),
        F.count("*").alias("n"),
    )


def compare_methods(scores: DataFrame, baseline: str, oracle: str) -> DataFrame:
    """Score per method and data set beside the baseline's and the oracle's."""
    def column(method: str, name: str) -> DataFrame:
        return scores.where(F.col("method") == method).select("dataset", F.col("score").alias(name))

    return (
        scores.join(column(baseline, "base"), "dataset", "left").join(column(oracle, "top"), "dataset", "left")
        .select(
            "method", "dataset", "score", (F.col("score") - F.col("base")).alias("delta"),
            F.when(F.col("top") != 0, F.col("score") / F.col("top") * 100).alias("percent_of_oracle"),
        )
    )


def method_table(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Data sets by methods."""
    return scores.groupBy("dataset").pivot("method", methods).agg(F.first("score"))


def class_shares(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and their share of all rows, per combination of keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn(
        "share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))
    )
