"""Attention layer over typed edges with given weights: projections, edge logits, weighted messages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions.vectors import relu
from rewardloom.session import cut_lineage


@dataclass(frozen=True)
class EdgeWeights:
    """Weights of one edge type: source and target maps (inputs x heads * width), ``heads`` attention vectors."""

    source: np.ndarray
    target: np.ndarray
    attention: np.ndarray  # heads x width
    bias: np.ndarray       # heads * width

    @property
    def heads(self) -> int:
        return self.attention.shape[0]


def linear(vector: Column, weights: np.ndarray) -> Column:
    """Dense map of an array column, as one numpy product an Arrow batch."""

    @F.pandas_udf("array<double>")
    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(np.stack(vectors.to_numpy()).astype(np.float64) @ weights))

    return mapped(vector)


def _edge_logits(own: Column, far: Column, weights: EdgeWeights, slope: float) -> Column:
    """Logit of each head: its attention vector times the leaky sum of both projections."""

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            if not len(left):
                yield pd.Series([], dtype=object)
                continue
            both = np.stack(left.to_numpy()) + np.stack(right.to_numpy())
            leaky = np.where(both > 0, both, slope * both).reshape(len(both), weights.heads, -1)
            yield pd.Series(list((leaky * weights.attention).sum(axis=2)))

    return logits(far, own)


def attended(nodes: DataFrame, edges: DataFrame, weights: EdgeWeights, loops: bool, slope: float = 0.2) -> DataFrame:
    """``id, vec``: messages of one edge type, weighed by a softmax over a target's edges, for each head.

    ``nodes`` are (id, vec), ``edges`` (src, dst). The softmax is never divided out:
    the message is the mean of the projected sources with weight exp(logit - peak),
    an aggregate that combines before the shuffle, so that a target with very many
    edges is spread over all tasks. ``loops`` adds an edge of each node to itself.
    """
    ends = edges.select("src", "dst")
    if loops:
        ends = ends.where("src <> dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    mapped = cut_lineage(nodes.select(
        "id", linear(F.col("vec"), weights.source).alias("sent"), linear(F.col("vec"), weights.target).alias("asked")), "mapped")
    met = ends.join(mapped.select(F.col("id").alias("src"), "sent"), "src").join(
        mapped.select(F.col("id").alias("dst"), "asked"), "dst")
    scored = cut_lineage(met.select(
        "dst", "sent", _edge_logits(F.col("asked"), F.col("sent"), weights, slope).alias("logits")), "logits")
    width = weights.attention.shape[1]
    each = scored.select("dst", "sent", F.posexplode("logits").alias("head", "logit")).select(
        "dst", "head", "logit", F.slice("sent", F.col("head") * width + 1, width).alias("part"))
    peaks = each.groupBy("dst", "head").agg(F.max("logit").alias("peak"))
    heads = each.join(peaks, ["dst", "head"]).groupBy("dst", "head").agg(vector_to_array(
        Summarizer.mean(array_to_vector("part"), F.exp(F.col("logit") - F.col("peak")))).alias("part"))
    bias = F.array(*[F.lit(float(b)) for b in weights.bias])
    whole = heads.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list(F.struct("head", "part"))).alias("heads"))
    joined = F.flatten(F.transform("heads", lambda h: h["part"]))
    return whole.select("id", F.zip_with(joined, bias, lambda x, b: x + b).alias("vec"))


def attention_layer(nodes: DataFrame, edges: DataFrame, weights: dict[str, EdgeWeights],
                    loops_for: str = "similar_to") -> DataFrame:
    """One layer: messages of each edge type that has weights, their mean over the types present, then ReLU.

    ``edges`` are (src, dst, edge_type). Types without weights send nothing, nodes
    without a message drop out. Edges to or from unknown nodes are not used.
    """
    typed = None
    for kind, own in sorted(weights.items()):
        part = attended(nodes, edges.where(F.col("edge_type") == kind), own, kind == loops_for)
        typed = part if typed is None else typed.unionByName(part)
    merged = typed.groupBy("id").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec"))
    return merged.select("id", relu(F.col("vec")).alias("vec"))


def attention_stack(nodes: DataFrame, edges: DataFrame, layers: list[dict[str, EdgeWeights]]) -> DataFrame:
    """Layers in order; nodes that a layer leaves without messages drop out of the next ones, as in the model."""
    for weights in layers:
        nodes = cut_lineage(attention_layer(nodes, edges, weights), "layer")
    return nodes
