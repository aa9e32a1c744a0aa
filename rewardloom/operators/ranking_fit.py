"""Reward model fitted with a pairwise ranking loss: full-batch gradient descent, one aggregate a step.

The loss adds, over all pairs of a success and a failure of one query, what the
success lacks of a lead of ``margin``. Its gradient needs no pairs: a success is
pulled up once for every failure above ``score - margin``, a failure pushed down
once for every success below ``score + margin``, and both numbers are running
counts over the scores of the query in order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.numeric import sigmoid
from rewardloom.functions.vectors import dot


@dataclass(frozen=True)
class RankingOptions:
    epochs: int = 150
    patience: int = 20
    rate: float = 0.05
    margin: float = 0.5
    ranking_weight: float = 0.5
    class_weight: bool = True


@dataclass(frozen=True)
class RewardModel:
    """A linear model on standardised features, and how the fit went."""

    weights: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    deviation: tuple[float, ...]
    best_epoch: int = 0
    best_metric: float = 0.0
    losses: tuple[float, ...] = field(default=())

    def logit(self, features: Column) -> Column:
        factors = [w / d if d else 0.0 for w, d in zip(self.weights, self.deviation, strict=True)]
        shift = self.bias - sum(f * m for f, m in zip(factors, self.mean, strict=True))
        return dot(features, _numbers(factors)) + F.lit(shift)


@dataclass(frozen=True)
class _Task:
    """What every step needs: rows by query with standardised ``x``, and sums over all of them."""

    rows: DataFrame
    pairs: int
    trained: int
    positive_weight: float


def _numbers(values: list[float] | np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def ranking_terms(scored: DataFrame, query: str, margin: float) -> DataFrame:
    """``pull`` (the loss's derivative by the score) and ``lack`` (the loss itself) of each row, by running counts.

    ``scored`` has ``score`` and ``reward``; rows with ``counts`` false say nothing.
    A pair's loss is booked on its success.
    """
    within = f"PARTITION BY {query}"
    upto = f"({within} ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND {{}})"
    good, bad = "IF(counts AND reward > 0.5, 1, 0)", "IF(counts AND reward <= 0.5, 1, 0)"
    beaten = upto.format(f"{float(margin)}D PRECEDING")
    near = upto.format(f"{float(margin)}D FOLLOWING")
    counted = scored.withColumns({
        "ahead": F.expr(f"SUM({bad}) OVER ({within}) - COALESCE(SUM({bad}) OVER {beaten}, 0)"),
        "ahead_sum": F.expr(f"SUM({bad} * score) OVER ({within}) - COALESCE(SUM({bad} * score) OVER {beaten}, 0)"),
        "below": F.expr(f"COALESCE(SUM({good}) OVER {near}, 0)"),
    })
    success, failure = F.col("counts") & (F.col("reward") > 0.5), F.col("counts") & (F.col("reward") <= 0.5)
    return counted.withColumns({
        "pull": F.when(success, -F.col("ahead")).when(failure, F.col("below")).otherwise(0).cast("double"),
        "lack": F.when(success, F.col("ahead") * (margin - F.col("score")) + F.col("ahead_sum")).otherwise(0.0),
    }).drop("ahead", "ahead_sum", "below")


def _step(task: _Task, weights: np.ndarray, bias: float, query: str, options: RankingOptions) -> dict:
    """Loss, its gradient and the counts behind the validation F1 at these weights: one job, numbers of fixed size."""
    scored = task.rows.withColumn("score", dot(F.col("x"), _numbers(weights)) + F.lit(float(bias)))
    rated = ranking_terms(scored, query, options.margin)
    positive, score = F.col("reward") > 0.5, F.col("score")
    weight = F.when(positive, task.positive_weight).otherwise(1.0)
    missing = F.col("reward") - sigmoid(score)
    # log(1 + exp(-|s|)) + max(s, 0) - s y, which does not overflow
    entropy = weight * (F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - F.when(positive, score).otherwise(0.0))
    share = options.ranking_weight / task.pairs if task.pairs else 0.0
    own = F.when(F.col("counts"), -weight * missing / task.trained).otherwise(0.0) + share * F.col("pull")
    said = score > 0
    out = rated.withColumn("g", own).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.transform("x", lambda v: v * F.col("g"))))).alias("gradient"),
        F.sum("g").alias("bias"),
        F.sum(F.when(F.col("counts"), entropy / task.trained).otherwise(0.0) + share * F.col("lack")).alias("loss"),
        F.count_if(~F.col("counts") & said & positive).alias("hit"),
        F.count_if(~F.col("counts") & (said != positive)).alias("wrong"),
    ).head()
    return {**out.asDict(), "f1": 2 * out["hit"] / (2 * out["hit"] + out["wrong"]) if out["hit"] else 0.0}


def fit_ranked_rewards(rows: DataFrame, query: str = "query_id", train: str = "is_train",
                       options: RankingOptions = RankingOptions()) -> RewardModel:
    """Fits on the rows where ``train`` holds and stops early on the F1 of the others.

    ``rows`` are (query, features array<double>, reward, train). The loss is class
    weighted cross entropy plus ``ranking_weight`` times the mean ranking loss of all
    pairs inside queries. Rows lie by query and stay so over all steps: a step sorts
    inside partitions and shuffles one row a partition. Rows without features or
    reward, and with a null query, are not used; without training rows the
    model is zero.
    """
    used = rows.where(F.col("features").isNotNull() & F.col("reward").isNotNull() & F.col(query).isNotNull())
    named = used.select(query, "features", F.col("reward").cast("double").alias("reward"),
                        F.coalesce(F.col(train), F.lit(False)).alias("counts"))
    if named.where("counts").isEmpty():
        return RewardModel((), 0.0, (), ())
    shape = named.where("counts").agg(
        F.count("*").alias("n"), F.count_if(F.col("reward") > 0.5).alias("good"),
        Summarizer.mean(array_to_vector("features")).alias("mean"), Summarizer.std(array_to_vector("features")).alias("std"),
    ).head()
    mean, deviation = shape["mean"].toArray(), shape["std"].toArray()
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
    standard = F.transform(F.arrays_zip("features", _numbers(mean).alias("m"), _numbers(scale).alias("s")),
                           lambda z: (z["features"] - z["m"]) * z["s"])
    by_query = named.withColumn("x", standard).drop("features").repartition(query).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pairs = by_query.where("counts").groupBy(query).agg(
            F.count_if(F.col("reward") > 0.5).alias("p"), F.count_if(F.col("reward") <= 0.5).alias("n")
        ).agg(F.coalesce(F.sum(F.col("p") * F.col("n")), F.lit(0))).head()[0]
        bad = shape["n"] - shape["good"]
        balance = bad / shape["good"] if options.class_weight and bad and shape["good"] else 1.0
        task = _Task(by_query, pairs, shape["n"], balance)
        return _descended(task, mean, deviation, query, options)
    finally:
        by_query.unpersist()


def _descended(task: _Task, mean: np.ndarray, deviation: np.ndarray, query: str, options: RankingOptions) -> RewardModel:
    """Adam's rule on the driver, over one number a feature."""
    place = np.zeros(len(mean) + 1)
    first, second = np.zeros_like(place), np.zeros_like(place)
    best, best_epoch, best_f1, losses = place.copy(), 0, -1.0, []
    for epoch in range(options.epochs + 1):
        at = _step(task, place[:-1], place[-1], query, options)
        losses.append(at["loss"])
        if epoch and at["f1"] > best_f1:
            best, best_epoch, best_f1 = place.copy(), epoch, at["f1"]
        if epoch - best_epoch >= options.patience or epoch == options.epochs:
            break
        gradient = np.append(at["gradient"], at["bias"])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        lead = first / (1 - 0.9 ** (epoch + 1))
        place = place - options.rate * lead / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    chosen = best if best_epoch else place
    return RewardModel(tuple(chosen[:-1]), float(chosen[-1]), tuple(mean), tuple(deviation), best_epoch, max(best_f1, 0.0),
                       tuple(losses))


def predict_ranked(model: RewardModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows with ``logit``, ``prob`` and ``predicted``; null features give nulls."""
    scored = rows.withColumn("logit", model.logit(F.col("features")) if model.weights else F.lit(0.0))
    return scored.withColumn("prob", sigmoid(F.col("logit"))).withColumn(
        "predicted", F.when(F.col("prob") > threshold, 1.0).when(F.col("prob").isNotNull(), 0.0))
