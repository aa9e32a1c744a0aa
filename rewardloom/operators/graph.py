"""Graph of queries, reasoning parts and answers as node and edge tables.

A clique over the rollouts of one query is kept in factored form: every member
points at its group, and sums over the group minus the member itself give exact
neighbour aggregates. Cost stays linear however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from rewardloom.config import EngineConfig
from rewardloom.functions.vectors import dot, unit
from rewardloom.operators.knn import knn_edges, knn_within_groups
from rewardloom.operators.ranking import ordered_rank


def node_name(kind: str, *keys: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), *[key.cast("string") for key in keys])


def _edge(src_type: str, src: Column, edge_type: str, dst_type: str, dst: Column) -> Column:
    return F.struct(
        F.lit(src_type).alias("src_type"), src.alias("src"), F.lit(edge_type).alias("edge_type"),
        F.lit(dst_type).alias("dst_type"), dst.alias("dst"), F.lit(1.0).alias("weight"),
    )


def structural_edges(rollouts: DataFrame, query: str = "query_id", resp: str = "resp_idx",
                     kinds: tuple[str, ...] = ("generates", "generates_reasoning", "leads_to"),
                     reverse: bool = True) -> DataFrame:
    """Query-answer, query-think and think-answer edges with their reverses.

    All of them come from one pass over the rollouts.
    """
    q = node_name("q", F.col(query))
    t = node_name("t", F.col(query), F.col(resp))
    a = node_name("a", F.col(query), F.col(resp))
    ends = {
        "generates": ("query", q, "answer", a),
        "generates_reasoning": ("query", q, "think", t),
        "leads_to": ("think", t, "answer", a),
    }
    made = []
    for kind in kinds:
        src_type, src, dst_type, dst = ends[kind]
        made.append(_edge(src_type, src, kind, dst_type, dst))
        if reverse:
            made.append(_edge(dst_type, dst, f"rev_{kind}", src_type, src))
    return rollouts.select(F.explode(F.array(*made)).alias("e")).select("e.*")


def domain_nodes(nodes: DataFrame, domain: str) -> DataFrame:
    return nodes.where(F.col("domain") == domain)


def domain_index(nodes: DataFrame, group: str = "domain", key: str = "id") -> DataFrame:
    """Dense index of the nodes of each domain; the id maps back."""
    ranked = ordered_rank(nodes, [group], key)
    return ranked.withColumn("local_index", F.col("rank") - 1).drop("rank")


def similar_in_domain(nodes: DataFrame, k: int = 15, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Query-query neighbours inside one domain."""
    return knn_edges(nodes, nodes, k, exclude="self", domain="domain", config=config)


def similar_in_memory(nodes: DataFrame, k: int = 7, same_domain: bool = False,
                      config: EngineConfig = EngineConfig()) -> DataFrame:
    """Memory-memory neighbours."""
    memory = nodes.where("is_memory")
    return knn_edges(memory, memory, k, exclude="self", domain="domain" if same_domain else None, config=config)


def similar_to_memory(nodes: DataFrame, k: int = 7, same_domain: bool = False,
                      config: EngineConfig = EngineConfig()) -> DataFrame:
    """New nodes attach to memory only, never to each other."""
    return knn_edges(
        nodes.where(~F.col("is_memory")), nodes.where("is_memory"), k,
        domain="domain" if same_domain else None, config=config,
    )


def remembered(nodes: DataFrame, k: int = 7, same_domain: bool = False, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Neighbours in memory of all nodes, in one search: the edges of the two functions above together."""
    return knn_edges(
        nodes.where(F.col("is_memory").isNotNull()), nodes.where("is_memory"), k, exclude="self",
        domain="domain" if same_domain else None, config=config)


def competing_in_query(nodes: DataFrame, k: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Top-k rollouts of the same query."""
    return knn_within_groups(nodes, "query_id", k, config)


def competing_across_queries(nodes: DataFrame, k: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Top-k rollouts of other queries."""
    return knn_edges(nodes, nodes, k, exclude="group", group="query_id", config=config)


def clique_degrees(nodes: DataFrame, group: str, kind: str) -> DataFrame:
    """Members of each clique with their degree; both directions count once each."""
    sizes = nodes.groupBy(group).agg(F.count("*").alias("members"))
    return nodes.join(sizes, group).select(
        F.lit(kind).alias("edge_type"), group, "id", "members",
        (F.col("members") - 1).alias("degree"),
    )


def clique_means(nodes: DataFrame, group: str) -> DataFrame:
    """Mean cosine similarity of each node to all others in its group.

    The sum of similarities to the others is the dot product with the group's
    vector sum, minus the node's product with itself.
    """
    base = nodes.select(group, "id", unit(F.col("embedding")).alias("vec"))
    sums = base.groupBy(group).agg(
        vector_to_array(Summarizer.sum(array_to_vector("vec"))).alias("total"),
        F.count("*").alias("members"),
    )
    others = F.col("members") - 1
    return base.join(sums, group).select(
        group, "id", others.alias("degree"),
        F.when(others > 0, (dot(F.col("vec"), F.col("total")) - dot(F.col("vec"), F.col("vec"))) / others)
        .alias("mean_sim"),
    )


def similar_edges(edges: DataFrame, kind: str = "q") -> DataFrame:
    """Neighbour edges in the common edge layout, weighted by similarity."""
    names = {"q": "query", "t": "think", "a": "answer"}
    return edges.select(
        F.lit(names[kind]).alias("src_type"), node_name(kind, F.col("src")).alias("src"),
        F.lit("similar_to" if kind == "q" else "competes_with").alias("edge_type"),
        F.lit(names[kind]).alias("dst_type"), node_name(kind, F.col("dst")).alias("dst"),
        F.col("sim").alias("weight"),
    )


def extended_nodes(nodes: DataFrame, rollouts: DataFrame) -> DataFrame:
    """``node_type, node, is_memory`` of all nodes; thinks and answers go with their query."""
    queries = nodes.select(F.lit("query").alias("node_type"), node_name("q", F.col("id")).alias("node"), "is_memory")
    owned = rollouts.select("query_id", "resp_idx").join(
        nodes.select(F.col("id").alias("query_id"), "is_memory"), "query_id")
    parts = [owned.select(F.lit(kind).alias("node_type"), node_name(kind[0], F.col("query_id"), F.col("resp_idx"))
                          .alias("node"), "is_memory") for kind in ("think", "answer")]
    return queries.unionByName(parts[0]).unionByName(parts[1])


def competing_thinks(rollouts: DataFrame, inside: int, across: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Neighbour edges of thinks: nearest of their own query and nearest of the others."""
    near = competing_in_query(rollouts, inside, config).unionByName(competing_across_queries(rollouts, across, config))
    names = rollouts.select("id", node_name("t", F.col("query_id"), F.col("resp_idx")).alias("name"))
    named = near.join(names.select(F.col("id").alias("src"), F.col("name").alias("from")), "src").join(
        names.select(F.col("id").alias("dst"), F.col("name").alias("to")), "dst")
    return named.select(
        F.lit("think").alias("src_type"), F.col("from").alias("src"), F.lit("competes_with").alias("edge_type"),
        F.lit("think").alias("dst_type"), F.col("to").alias("dst"), F.col("sim").alias("weight"))


def extended_graph(nodes: DataFrame, rollouts: DataFrame, config: EngineConfig = EngineConfig(),
                   competing: tuple[int, int] | None = None) -> DataFrame:
    """Edges over memory and new nodes together, under composite keys.

    With ``competing`` (neighbours in the query, across queries) the rollouts carry
    ``id`` and ``embedding`` of their thinks, which get edges among themselves.
    Answer cliques stay factored, see :func:`clique_degrees`.
    """
    same = config.domain_filter
    near = remembered(nodes, config.k, same, config)
    edges = structural_edges(rollouts).unionByName(similar_edges(near))
    return edges if competing is None else edges.unionByName(competing_thinks(rollouts, *competing, config))


def edge_statistics(edges: DataFrame) -> DataFrame:
    """Edges, distinct sources and mean out-degree per edge type."""
    degrees = edges.groupBy("edge_type", "src").agg(F.count("*").alias("degree"))
    return degrees.groupBy("edge_type").agg(
        F.sum("degree").alias("edges"), F.count("*").alias("sources"),
        F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"),
    )


def structural_statistics(rollouts: DataFrame, query: str = "query_id", resp: str = "resp_idx") -> DataFrame:
    """:func:`edge_statistics` of :func:`structural_edges`, from counts of rollouts.

    An edge's source is a query or one of its responses, so that degrees follow from
    the rows of each; no edge is written, and both counts share one shuffle by query.
    """
    responses = rollouts.groupBy(query, resp).agg(F.count("*").alias("n"))
    queries = responses.groupBy(query).agg(
        F.sum("n").alias("n"), F.count("*").alias("sources"), F.max("n").alias("most"))
    totals = queries.agg(F.sum("n").alias("edges"), F.count("*").alias("q"), F.max("n").alias("q_most"),
                         F.sum("sources").alias("r"), F.max("most").alias("r_most")).where(F.col("edges").isNotNull())

    def kind(name: str, side: str) -> Column:
        return F.struct(F.lit(name).alias("edge_type"), F.col(side).alias("sources"), F.col(f"{side}_most").alias("max_degree"))

    kinds = [kind(name, side) for name, side in (
        ("generates", "q"), ("rev_generates", "r"), ("generates_reasoning", "q"), ("rev_generates_reasoning", "r"),
        ("leads_to", "r"), ("rev_leads_to", "r"))]
    each = totals.select("edges", F.explode(F.array(*kinds)).alias("k"))
    return each.select("k.edge_type", "edges", "k.sources", F.round(F.col("edges") / F.col("k.sources"), 6).alias("avg_degree"),
                       "k.max_degree")


def rollout_triples(queries: DataFrame, thinks: DataFrame, answers: DataFrame) -> DataFrame:
    """Query, think and answer vectors side by side, by explicit keys."""
    return thinks.join(answers, ["query_id", "resp_idx"]).join(queries, "query_id")
