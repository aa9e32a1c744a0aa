"""Mixed reward: each prompt group is scored with ground truth or along the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.config import EngineConfig
from rewardloom.functions.domains import dataset_name, query_identifier, route_family, scoring_domain
from rewardloom.functions.numeric import numeric_answer
from rewardloom.functions.text import split_scored
from rewardloom.functions.vectors import short_unit, sum_vectors, word_vectors
from rewardloom.operators.features import feature_vector
from rewardloom.operators.knn import knn_edges, search_index
from rewardloom.operators.propagate import memory_sums, probability, weighted_sums
from rewardloom.operators.routing import answer_or, entry, gate_batches, is_train, parse_extra, prompt_key, with_gt_flag
from rewardloom.operators.scoring import gt_reward
from rewardloom.session import cut_lineage, scratch_folder, store, work_folder

TEXT = 8                  # places of the think and of the answer vector
FEATURES = 3 + 2 * TEXT
GROUP = ["batch_id", "prompt_key"]


def response_features(response: Column) -> Column:
    """What a response says, whatever its domain: its think and its answer part as word vectors."""
    parts = split_scored(response)
    return word_vectors(parts["think"], parts["answer"], length=TEXT)


@dataclass(frozen=True)
class GraphMemory:
    """Labelled rollouts (query_id, features, reward) and their queries (id, domain, embedding)."""

    rows: DataFrame
    nodes: DataFrame


def scored_rollouts(rollouts: DataFrame, describe: Callable[[Column], Column] = response_features) -> DataFrame:
    """Rollouts with everything that needs no other row.

    One projection: ground-truth reward, numeric answer, prompt key and the raw
    routing fields. ``extra_info`` is JSON text and is parsed once.
    """
    keyed = rollouts.withColumn("extra", parse_extra(F.col("extra_info"))).withColumns({
        "prompt_key": prompt_key(F.col("extra"), F.col("data_source"), F.col("resp_idx")),
        "domain": scoring_domain(F.col("data_source")),
        "is_train": is_train(F.col("extra")),
        "index": entry(F.col("extra"), "index"),
        "problem_id": entry(F.col("extra"), "problem_id"),
        "truth": answer_or(F.col("extra"), F.col("ground_truth")),
    })
    passed = F.col("all_passed") if "all_passed" in rollouts.columns else None
    return keyed.select(
        *GROUP, "query_id", "resp_idx", "data_source", "domain", "is_train", "index", "problem_id",
        gt_reward(F.col("domain"), F.col("response"), F.col("truth"), passed).alias("gt_reward"),
        F.when(F.col("domain") == "math", numeric_answer(F.col("response"))).alias("answer"),
        describe(F.col("response")).alias("said"),
    )


def prompt_table(scored: DataFrame, gt_ids: DataFrame, reference_families: bool = True) -> DataFrame:
    """One row per prompt group: route, representative query and consensus.

    The first step counts equal answers with a hash aggregate over plain keys, so
    only distinct answers reach the later steps. Routing and the id join then run on
    prompts, not on rollouts; the validation gate needs the batches of the rollouts alone.
    """
    votes = scored.withColumn("_rounded", F.round("answer", 2)).groupBy(
        *GROUP, "_rounded", "query_id", "data_source", "index", "problem_id"
    ).agg(F.count("*").alias("_votes"), F.min("resp_idx").alias("_first"))
    per_answer = votes.groupBy(*GROUP, "_rounded").agg(
        F.sum("_votes").alias("_votes"),
        F.min(F.struct("query_id", "_first", "data_source", "index", "problem_id")).alias("head"),
    )
    rank = F.when(F.col("_rounded").isNotNull(), F.struct(
        F.col("_votes"), -F.col("head.query_id"), -F.col("head._first")))
    prompts = per_answer.groupBy(*GROUP).agg(
        F.min("head").alias("head"), F.max_by("_rounded", rank).alias("consensus"),
    )
    source = F.col("head.data_source")
    named = prompts.select(
        *GROUP, F.col("head.query_id").alias("node"), "consensus",
        dataset_name(source).alias("dataset"), route_family(source).alias("family"),
        query_identifier(source, F.col("head.index"), F.col("head.problem_id")).alias("identifier"),
    )
    flagged = with_gt_flag(named, gt_ids, ["dataset", "identifier"])
    gated = gate_batches(flagged, "batch_id", rows=scored)
    use_gt = F.col("in_gt")
    if reference_families:
        use_gt = use_gt & F.col("family").isNotNull()
    route = F.when(F.col("validation"), "validation").when(use_gt, "gt").otherwise("graph")
    return gated.select(*GROUP, "node", "consensus", route.alias("route"))


def unit_features(config: EngineConfig, length: int) -> Column:
    """Answer features and response features of a rollout as one unit vector."""
    answer = feature_vector(F.col("answer"), F.col("consensus"), F.col("domain"), config.strict_zero)
    return short_unit(F.concat(answer, F.col("said")), length)


def _keyed(vectors: DataFrame) -> DataFrame:
    """Query vectors with their domain and a 128-bit key of both."""
    named = vectors.select("query_id", scoring_domain(F.col("data_source")).alias("domain"), "embedding")
    return named.withColumns({
        "h1": F.xxhash64("domain", "embedding"), "h2": F.xxhash64(F.lit("v"), F.reverse("embedding"), "domain")})


@dataclass(frozen=True)
class KeyedVectors:
    """``node, s1, s2, held`` of every query with vectors, and ``h1, h2, domain, embedding`` once for all that are equal.

    Many queries can share a vector, so only its key goes with each of them as ``s1, s2``;
    a node of several vectors has the key of their list there, and the list in ``held``.
    """

    listed: DataFrame
    distinct: DataFrame

    def stored(self) -> KeyedVectors:
        """The same, written once for all jobs that read it."""
        return KeyedVectors(cut_lineage(self.listed, "keys"), cut_lineage(self.distinct, "vectors"))


def keyed_vectors(vectors: DataFrame) -> KeyedVectors:
    """From (query_id, data_source, embedding)."""
    keyed = _keyed(vectors)
    held = keyed.where(F.col("query_id").isNotNull()).groupBy(F.col("query_id").alias("node")).agg(
        F.sort_array(F.collect_list(F.struct("h1", "h2"))).alias("held"))
    only, several = F.get("held", 0), F.size("held") > 1
    listed = held.select(
        "node", F.when(several, F.xxhash64("held")).otherwise(only["h1"]).alias("s1"),
        F.when(several, F.xxhash64(F.lit("s"), F.reverse("held"))).otherwise(only["h2"]).alias("s2"), F.when(several, F.col("held")).alias("held"))
    return KeyedVectors(listed, keyed.groupBy("h1", "h2").agg(
        F.first("domain").alias("domain"), F.first("embedding").alias("embedding")))


def _nodes(named: DataFrame, distinct: DataFrame) -> DataFrame:
    """Query nodes ``id, s1, s2, held`` with each of their vectors."""
    only = F.array(F.struct(F.col("s1").alias("h1"), F.col("s2").alias("h2")))
    each = named.where(F.col("s1").isNotNull()).select("id", F.explode(F.coalesce("held", only)).alias("v")).select("id", "v.h1", "v.h2")
    return each.join(distinct, ["h1", "h2"]).select("id", "domain", "embedding")


def _remembered(labelled: DataFrame, prompts: DataFrame, distinct: DataFrame, features: Column) -> GraphMemory:
    """From the rollouts on the ground-truth route, with their ``node`` and ``consensus``."""
    rows = labelled.select(F.col("node").alias("query_id"), features.alias("features"), F.col("gt_reward").alias("reward"))
    known = prompts.where(F.col("route") == "gt").withColumnRenamed("node", "id")
    return GraphMemory(rows, _nodes(known, distinct))


def graph_memory(rollouts: DataFrame, gt_ids: DataFrame, vectors: DataFrame | KeyedVectors, config: EngineConfig = EngineConfig(),
                 reference_families: bool = True) -> GraphMemory:
    """The ground-truth-routed part of labelled rollouts, written once, as static memory of later jobs."""
    spark, folder = rollouts.sparkSession, work_folder(rollouts.sparkSession)
    keyed = vectors if isinstance(vectors, KeyedVectors) else keyed_vectors(vectors)
    with scratch_folder(spark):
        scored = cut_lineage(scored_rollouts(rollouts), "scored")
        prompts = cut_lineage(prompt_table(scored, gt_ids, reference_families).join(keyed.listed, "node", "left"), "prompts")
        known = prompts.where(F.col("route") == "gt").select(*GROUP, "node", "consensus")
        memory = _remembered(scored.join(known, GROUP), prompts, keyed.distinct, unit_features(config, FEATURES))
        return GraphMemory(cut_lineage(memory.rows, "memory", folder), cut_lineage(memory.nodes, "memory-nodes", folder))


def _key_sums(first: DataFrame, distinct: DataFrame, nodes: DataFrame, sums: DataFrame, length: int,
              config: EngineConfig, connect: Callable[..., DataFrame]) -> DataFrame:
    """Neighbour sums of each key ``s1, s2``: the node of ``first`` searches for all that share it."""
    edges = connect(
        _nodes(first, distinct).withColumn("route", F.lit("graph")),
        nodes, config.k, domain="domain" if config.domain_filter else None, config=config,
    )
    return first.select("s1", "s2", F.col("id").alias("query_id")).join(
        weighted_sums(sums, edges, length), "query_id").drop("query_id")


class MemorySearch:
    """What jobs against one memory share, stored once, so that a job pays for its own rows alone.

    That is the keys of the query vectors, the memory ready to be searched, and the sums
    of its rollouts by query. A vector is searched by the first job that meets it; its
    neighbour sums are kept for the later ones, with nulls where nothing was found. They
    come from the memory alone, so a job that is repeated gets the same.
    """

    def __init__(self, vectors: DataFrame | KeyedVectors, memory: GraphMemory, config: EngineConfig = EngineConfig(),
                 described: int = 2 * TEXT):
        self.keyed = vectors if isinstance(vectors, KeyedVectors) else keyed_vectors(vectors).stored()
        self.memory, self.config, self.length = memory, config, 3 + described
        self.sums = cut_lineage(memory_sums(memory.rows, "query_id", self.length), "memory-sums")
        self.index = search_index(memory.nodes, config.k, domain="domain" if config.domain_filter else None, config=config)
        self.folder = work_folder(memory.rows.sparkSession)
        self.found: list[str] = []

    def key_sums(self, first: DataFrame, connect: Callable[..., DataFrame]) -> DataFrame:
        """Neighbour sums of the keys in ``first`` and of all that were asked for before."""
        spark = self.memory.rows.sparkSession
        read = lambda: spark.read.schema(self.schema).parquet(*self.found)
        if self.found:
            first = cut_lineage(first.join(read().select("s1", "s2"), ["s1", "s2"], "left_anti"), "unsearched")
        if not self.found or not first.isEmpty():
            sums = _key_sums(first, self.keyed.distinct, self.memory.nodes, self.sums, self.length, self.config,
                             partial(connect, index=self.index))
            sums = first.select("s1", "s2").join(sums, ["s1", "s2"], "left")
            path = f"{self.folder}/key-sums-{uuid.uuid4().hex}"
            self.schema = store(sums, path).schema
            self.found.append(path)
        return read()


def mixed_reward(rollouts: DataFrame, gt_ids: DataFrame, vectors: DataFrame | KeyedVectors,
                 config: EngineConfig = EngineConfig(), memory: GraphMemory | MemorySearch | None = None,
                 reference_families: bool = True, describe: Callable[[Column], Column] = response_features,
                 described: int = 2 * TEXT, connect: Callable[..., DataFrame] = knn_edges) -> DataFrame:
    """Reward per rollout with its source: ``gt``, ``graph``, ``validation``, ``gt_fallback``.

    ``vectors`` are (query_id, data_source, embedding). The memory of the graph
    branch is the ground-truth-routed part of the input unless one is given; then
    a prompt's reward depends on its own batch and the memory alone. Several jobs
    against one memory give a :class:`MemorySearch` of it and its ``keyed`` vectors. Rollouts no
    neighbour speaks for fall back to ground truth, as does a whole validation batch.

    ``describe`` turns a response into ``described`` numbers, which join the answer
    features; ``connect`` finds the edges from new queries to remembered ones and
    takes what :func:`knn_edges` takes. Both can be replaced.
    """
    length = 3 + described
    features = unit_features(config, length)
    spark, folder = rollouts.sparkSession, work_folder(rollouts.sparkSession)
    keyed = vectors if isinstance(vectors, KeyedVectors) else keyed_vectors(vectors)
    on_route = (F.col("route") == "graph") & F.col("s1").isNotNull()
    # The result reads two of the tables cut in here, the others go as soon as nothing needs them.
    with scratch_folder(spark) as job:
        with scratch_folder(spark):
            # The scored table feeds several branches; it is narrow (no texts), so writing it
            # once is cheaper than parsing every response per branch.
            scored = cut_lineage(scored_rollouts(rollouts, describe), "scored")
            routed = cut_lineage(prompt_table(scored, gt_ids, reference_families), "routed")
            # The search, its size check and the memory all read the prompts and the vectors.
            prompts = cut_lineage(routed.join(keyed.listed, "node", "left"), "prompts", job)
            # The rollouts meet their prompts once, for the memory and the result.
            said = prompts.select(*GROUP, "node", "consensus", "route", *[F.when(on_route, F.col(c)).alias(c) for c in ("s1", "s2")])
            placed = cut_lineage(scored.join(said, GROUP).select(
                "data_source", "query_id", "resp_idx", "domain", "gt_reward", "answer", "said", "consensus", "route", "s1", "s2",
                F.when(F.col("route") == "gt", F.col("node")).alias("node")), "placed", folder)
        # Equal vectors have equal neighbours: one node searches for all, and sums are made once.
        first = cut_lineage(prompts.where(on_route).groupBy("s1", "s2").agg(F.min("node").alias("id"), F.first("held").alias("held")), "first")
        if isinstance(memory, MemorySearch):
            sums = memory.key_sums(first, connect)
        else:
            distinct = keyed.distinct if isinstance(vectors, KeyedVectors) else cut_lineage(keyed.distinct, "vectors")
            memory = memory or _remembered(placed.where(F.col("route") == "gt"), prompts, distinct, features)
            known = cut_lineage(memory_sums(memory.rows, "query_id", length), "memory-sums")
            sums = cut_lineage(_key_sums(first, distinct, memory.nodes, known, length, config, connect), "sums", folder)
    # Only rollouts with a say in this are dealt by key; the others stay where they are.
    columns = ["data_source", "query_id", "resp_idx", "gt_reward", "route", "prob"]
    asked = placed.where(F.col("s1").isNotNull()).join(sums, ["s1", "s2"], "left").withColumn("features", features)
    silent = placed.where(F.col("s1").isNull()).withColumn("prob", F.lit(None).cast("double"))
    inferred = asked.withColumn("prob", probability(F.col("features"))).select(*columns).unionByName(silent.select(*columns))
    on_graph = F.col("prob").isNotNull()
    graph_reward = F.when(F.col("prob") > config.threshold, 1.0).otherwise(0.0)
    return inferred.select(
        "data_source", "query_id", "resp_idx",
        F.when(on_graph, graph_reward).otherwise(F.col("gt_reward")).alias("reward"),
        F.when(on_graph, "graph").when(F.col("route") == "graph", "gt_fallback").otherwise(F.col("route"))
        .alias("reward_source"),
        "prob",
    )


def reward_statistics(rewards: DataFrame, source: Column | None = None) -> DataFrame:
    kind = F.col("reward_source") if source is None else source
    return rewards.groupBy(kind.alias("reward_source")).agg(
        F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward")
    )
