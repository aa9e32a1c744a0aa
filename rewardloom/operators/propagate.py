"""Reward inference along the graph: propagation, message passing, fitting."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.let import let
from rewardloom.functions.numeric import sigmoid
from rewardloom.functions.vectors import dot, relu, sum_vectors
from rewardloom.session import cut_lineage


def memory_sums(memory: DataFrame, query: str, length: int) -> DataFrame:
    """What propagation needs of a labelled query, in one fixed-size row."""
    vec, reward = F.col("features"), F.col("reward")
    return memory.groupBy(query).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(reward).alias("r"),
        sum_vectors(vec, length).alias("u"),
        sum_vectors(vec, length, reward).alias("v"),
    )


def neighbour_sums(memory: DataFrame, edges: DataFrame, length: int, query: str = "query_id") -> DataFrame:
    """Similarity-weighted sums over the labelled neighbours of each query."""
    return weighted_sums(memory_sums(memory, query, length), edges, length, query)


def weighted_sums(sums: DataFrame, edges: DataFrame, length: int, query: str = "query_id") -> DataFrame:
    """:func:`neighbour_sums` from the sums of :func:`memory_sums`."""
    w = F.greatest(F.col("sim"), F.lit(0.0))
    return edges.join(sums.withColumnRenamed(query, "dst"), "dst").groupBy(F.col("src").alias(query)).agg(
        F.sum(w * F.col("n")).alias("n"),
        F.sum(w * F.col("r")).alias("r"),
        sum_vectors(F.col("u"), length, w).alias("u"),
        sum_vectors(F.col("v"), length, w).alias("v"),
    )


def probability(features: Column) -> Column:
    """Probability of a rollout from its query's neighbour sums.

    Nine decimals: sums come in any order, and equal ones must meet the threshold
    alike. Null without a usable neighbour. Products written out element by element
    make a method too long to be compiled, so they are lambdas here.
    """
    top = F.col("r") + dot(features, F.col("v"))
    bottom = F.col("n") + dot(features, F.col("u"))
    return let(F.struct(top.alias("top"), bottom.alias("bottom")),
               lambda x: F.when(x["bottom"] > 0, F.round(x["top"] / x["bottom"], 9)))


def propagate(new: DataFrame, memory: DataFrame, edges: DataFrame, length: int, query: str = "query_id",
              threshold: float = 0.5) -> DataFrame:
    """Probability and reward of unlabelled rollouts from labelled neighbours.

    A labelled rollout ``s`` of a neighbour query at similarity ``w`` counts for
    rollout ``r`` with weight ``max(w, 0) * (1 + <r, s>) / 2`` over unit feature
    vectors. The sum over all pairs factors into per-query sums, so neighbours
    are added up per query and each rollout then meets one row:

        sum_s w (1 + <r, s>) R_s  =  w (sum R_s + <r, sum R_s s>)

    Rollouts without a usable neighbour keep a null probability.
    """
    joined = new.join(neighbour_sums(memory, edges, length, query), query, "left")
    inferred = joined.withColumn("prob", probability(F.col("features"))).drop("n", "r", "u", "v")
    return inferred.withColumn(
        "reward", F.when(F.col("prob") > threshold, 1.0).when(F.col("prob").isNotNull(), 0.0)
    )


def _mean_vector(weight: Column | None = None) -> Column:
    vector = array_to_vector("vec")
    picked = Summarizer.mean(vector) if weight is None else Summarizer.mean(vector, weight)
    return vector_to_array(picked)


def message_layer(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """One layer: mean per edge type, mean over the types present, then ReLU.

    ``nodes`` are (id, vec); ``edges`` are (src, dst, edge_type[, weight]). Nodes
    without incoming edges drop out, as in the layer it stands for.
    """
    sent = edges.join(nodes.withColumnRenamed("id", "src"), "src")
    per_type = sent.groupBy("dst", "edge_type").agg(
        _mean_vector(F.col(weight) if weight else None).alias("vec")
    )
    merged = per_type.groupBy("dst").agg(_mean_vector().alias("vec"))
    return merged.select(F.col("dst").alias("id"), relu(F.col("vec")).alias("vec"))


def message_stack(nodes: DataFrame, edges: DataFrame, layers: int, kinds: list[str] | None = None,
                  weight: str | None = None) -> DataFrame:
    """K layers over the chosen edge types; lineage is cut between layers.

    Nodes that a layer leaves without messages keep their previous vector.
    """
    kept = edges if kinds is None else edges.where(F.col("edge_type").isin(kinds))
    state = nodes
    for layer in range(layers):
        fresh = message_layer(state, kept, weight).withColumnRenamed("vec", "new_vec")
        state = state.join(fresh, "id", "left").select(
            "id", F.coalesce("new_vec", "vec").alias("vec")
        )
        if layer + 1 < layers:
            state = cut_lineage(state)
    return state


def attention(edges: DataFrame, temperature: float = 1.0, loops_for: str = "similar_to") -> DataFrame:
    """Softmax of edge scores over the incoming edges of a node, per edge type.

    Only ``loops_for`` gets self loops. Maxima and sums are aggregates joined
    back, so a node with very many edges is never sorted in one task.
    """
    loops = edges.where(F.col("edge_type") == loops_for).select("dst").distinct()
    loops = loops.select(F.col("dst").alias("src"), "dst", F.lit(loops_for).alias("edge_type"),
                         F.lit(1.0).alias("weight"))
    scored = edges.select("src", "dst", "edge_type", "weight").unionByName(loops).withColumn(
        "score", F.col("weight") / temperature
    )
    keys = ["dst", "edge_type"]
    peaks = scored.groupBy(*keys).agg(F.max("score").alias("peak"))
    raised = scored.join(peaks, keys).withColumn("e", F.exp(F.col("score") - F.col("peak")))
    totals = raised.groupBy(*keys).agg(F.sum("e").alias("total"))
    return raised.join(totals, keys).select(
        "src", "dst", "edge_type", (F.col("e") / F.col("total")).alias("attention")
    )


def dot_score(query: Column, response: Column, bias: float = 0.0) -> Column:
    """Scaled dot product of a query and a response vector."""
    return dot(query, response) / F.sqrt(F.size(query).cast("double")) + F.lit(bias)


def score_pairs(pairs: DataFrame, bias: float = 0.0, threshold: float = 0.5) -> DataFrame:
    logit = dot_score(F.col("query_vec"), F.col("response_vec"), bias)
    return pairs.withColumn("logit", logit).withColumn("prob", sigmoid(F.col("logit"))).withColumn(
        "reward", F.when(F.col("prob") > threshold, 1.0).otherwise(0.0)
    )


def neighbour_features(new: DataFrame, edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """Mean and weighted mean reward of labelled neighbours, and their number."""
    rewards = labelled.groupBy(F.col("query_id").alias("dst")).agg(F.avg("reward").alias("rate"))
    w = F.greatest(F.col("sim"), F.lit(0.0))
    seen = edges.join(rewards, "dst").groupBy(F.col("src").alias("query_id")).agg(
        F.avg("rate").alias("mean_rate"),
        (F.sum(w * F.col("rate")) / F.sum(w)).alias("weighted_rate"),
        F.count("*").cast("double").alias("neighbours"),
    )
    return new.join(seen, "query_id", "left").fillna(0.0, ["mean_rate", "weighted_rate", "neighbours"])


def fit_rewards(labelled: DataFrame, columns: list[str], label: str = "reward"):
    """Class-weighted logistic regression; positives weigh negatives/positives."""
    balance = labelled.agg(
        F.count_if(F.col(label) <= 0.5).alias("neg"), F.count_if(F.col(label) > 0.5).alias("pos")
    ).head()
    weight = balance["neg"] / balance["pos"] if balance["pos"] else 1.0
    training = labelled.withColumn("y", (F.col(label) > 0.5).cast("double")).withColumn(
        "w", F.when(F.col("y") == 1.0, weight).otherwise(1.0)
    )
    assembler = VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=50)
    return Pipeline(stages=[assembler, model]).fit(training)


def predict_rewards(model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    scored = model.transform(df)
    prob = F.get(vector_to_array("probability"), 1)
    return scored.select(*df.columns, prob.alias("prob")).withColumn(
        "predicted", F.when(F.col("prob") > threshold, 1.0).otherwise(0.0)
    )


def transductive(rollouts: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """Train labels only, every rollout scored: validation labels stay hidden."""
    memory = rollouts.where(F.col("split") == "train")
    return propagate(rollouts.withColumnRenamed("reward", "label"), memory, edges, length)
