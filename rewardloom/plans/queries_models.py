"""Registered queries: fitted and given models over rollouts and the graph, foreign scorers, named configurations."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rewardloom.operators import descent, graph, ranking_fit
from rewardloom.operators.attention import EdgeWeights, attention_layer
from rewardloom.operators.external import external_reward
from rewardloom.operators.spreading import spread_rewards
from rewardloom.plans.queries_graph import (
    _EDGES, _RSIMS, NODES, RNODES, SIMS, exploded, nodes_of, rollout_nodes_of, two_type_edges, vectors_of,
)
from rewardloom.plans.registry import ROLLOUTS, ctes, query, r6
from rewardloom.session import cut_lineage
from rewardloom.sources import feeds

# --- ranking loss ------------------------------------------------------------


@query("prp6_ranking_gradient", RNODES + """,
s AS (SELECT *, 4 * embedding[1] AS score, id % 3 <> 0 AS counts FROM rollout_nodes),
pairs AS (
  SELECT p.id AS p, n.id AS n, 0.5 - (p.score - n.score) AS lack FROM s p JOIN s n ON p.query_id = n.query_id
    AND p.reward > 0.5 AND n.reward <= 0.5 AND p.counts AND n.counts WHERE p.score - n.score < 0.5)
SELECT id, CAST(coalesce((SELECT count(*) FROM pairs WHERE n = id), 0) - coalesce((SELECT count(*) FROM pairs WHERE p = id), 0) AS DOUBLE) AS pull,
  round(coalesce((SELECT sum(lack) FROM pairs WHERE p = id), 0), 6) + 0.0::DOUBLE AS lack FROM s""")
def _(spark, root):
    """Derivative of the pairwise loss by each score, from running counts; the SQL lists the pairs."""
    rows = rollout_nodes_of(spark, root).withColumns(
        {"score": 4 * F.get("embedding", 0), "counts": F.col("id") % 3 != 0})
    terms = ranking_fit.ranking_terms(rows, "query_id", 0.5)
    return terms.select("id", r6(F.col("pull")).alias("pull"), r6(F.col("lack")).alias("lack"))


@query("prp6_ranked_rewards")
def _(spark, root):
    """Every rollout scored by the model fitted on two thirds of the queries; tests hold the gradient to differences."""
    rows = rollout_nodes_of(spark, root).select(
        "id", "query_id", "reward", F.col("embedding").alias("features"), (F.col("query_id") % 3 != 0).alias("is_train"))
    model = ranking_fit.fit_ranked_rewards(rows, options=ranking_fit.RankingOptions(epochs=25, patience=10))
    return ranking_fit.predict_ranked(model, rows).select(
        "id", "query_id", "reward", r6(F.col("prob")).alias("prob"), "predicted")


# --- attention ---------------------------------------------------------------

HEADS, WIDTH = 2, 4


def formula_weights(inputs: int) -> EdgeWeights:
    """Weights that SQL can state as well; trained ones are passed alike."""
    d, o = np.arange(inputs)[:, None], np.arange(HEADS * WIDTH)[None, :]
    h, w = np.arange(HEADS)[:, None], np.arange(WIDTH)[None, :]
    return EdgeWeights(
        ((d * 7 + o * 3) % 5 - 2) / 10, ((d * 3 + o * 5) % 7 - 3) / 10, ((h * 2 + w) % 3 - 0.5) * 4, np.arange(HEADS * WIDTH) / 100)


@query("prp2_attention_layer", NODES + _EDGES + f"""
w AS (SELECT id, o, sum(x * (((d - 1) * 7 + o * 3) % 5 - 2) / 10) AS sent, sum(x * (((d - 1) * 3 + o * 5) % 7 - 3) / 10) AS asked
  FROM xy, (SELECT unnest(range({HEADS * WIDTH})) AS o) GROUP BY ALL),
ends AS (SELECT src, dst, edge_type FROM edges WHERE edge_type <> 'similar_to' OR src <> dst
  UNION ALL SELECT id, id, 'similar_to' FROM query_nodes),
logits AS (
  SELECT src, dst, edge_type, s.o // {WIDTH} AS h,
    sum(((s.o // {WIDTH} * 2 + s.o % {WIDTH}) % 3 - 0.5) * 4 *
      CASE WHEN s.sent + t.asked > 0 THEN s.sent + t.asked ELSE 0.2 * (s.sent + t.asked) END) AS logit
  FROM ends JOIN w s ON s.id = src JOIN w t ON t.id = dst AND t.o = s.o GROUP BY src, dst, edge_type, s.o // {WIDTH}),
messages AS (
  SELECT dst, edge_type, o, sum(exp(logit) * sent) / sum(exp(logit)) + o / 100.0::DOUBLE AS x
  FROM logits JOIN w ON w.id = src AND o // {WIDTH} = h GROUP BY dst, edge_type, o)
SELECT dst AS id, o + 1 AS d, round(greatest(avg(x), 0), 6) + 0.0::DOUBLE AS value FROM messages GROUP BY dst, o""")
def _(spark, root):
    weights = dict.fromkeys(("similar_to", "leads_to"), formula_weights(64))
    return exploded(attention_layer(vectors_of(spark, root), two_type_edges(spark, root), weights))


# --- spreading to a fixed point ------------------------------------------------

SPREAD_ROUNDS = 24
_WEIGHTED = ctes("query_nodes", "rollout_nodes") + SIMS + _RSIMS.rstrip() + """,
ends AS (SELECT id AS vec_id, reward, query_id, 'q:' || query_id AS q, 't:' || query_id || ':' || resp_idx AS t,
  'a:' || query_id || ':' || resp_idx AS a FROM rollout_nodes),
edges AS (
  SELECT src, dst, sum(weight) AS weight FROM (
    SELECT unnest([q, a, q, t, t, a]) AS src, unnest([a, q, t, q, a, t]) AS dst, 1.0::DOUBLE AS weight FROM ends
    UNION ALL SELECT 'q:' || src, 'q:' || dst, sim FROM (SELECT * FROM sims WHERE dm AND src <> dst AND sim > -1
      QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 7)
    UNION ALL SELECT x.t, y.t, sim FROM (
      SELECT src, dst, sim FROM rsims WHERE sq = dq QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 3
      UNION ALL SELECT src, dst, sim FROM rsims WHERE sq <> dq QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5) e
      JOIN ends x ON x.vec_id = e.src JOIN ends y ON y.vec_id = e.dst)
  WHERE weight > 0 GROUP BY ALL),
shares AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY dst) AS share FROM edges),
nodes AS MATERIALIZED (
  SELECT 'q:' || id AS id, NULL::DOUBLE AS reward FROM query_nodes UNION ALL SELECT t, NULL FROM ends
  UNION ALL SELECT a, CASE WHEN query_id % 5 <> 0 THEN reward END FROM ends),
r0 AS MATERIALIZED (SELECT id, coalesce(reward, 0.5) AS value FROM nodes)"""
_ROUNDS = "".join(f""",
r{n + 1} AS MATERIALIZED (SELECT n.id, coalesce(n.reward, 0.7 * 0.5 + 0.3 * m.x, 0.5) AS value FROM nodes n LEFT JOIN (
  SELECT dst, sum(share * value) AS x FROM shares JOIN r{n} ON src = id GROUP BY dst) m ON m.dst = n.id)""" for n in range(SPREAD_ROUNDS))


@query("prp7_spread_rewards", _WEIGHTED + _ROUNDS + f"""
SELECT n.id, n.reward IS NOT NULL AS clamped, round(value, 6) + 0.0::DOUBLE AS value FROM nodes n JOIN r{SPREAD_ROUNDS} USING (id)""")
def _(spark, root):
    """Rewards of memory answers spread over query, think and answer edges until nothing moves."""
    nodes, rollouts = nodes_of(spark, root), rollout_nodes_of(spark, root)
    name = lambda kind: graph.node_name(kind, F.col("query_id"), F.col("resp_idx")).alias("id")
    unknown = F.lit(None).cast("double").alias("reward")
    known = F.when(F.col("query_id") % 5 != 0, F.col("reward")).alias("reward")
    every = nodes.select(graph.node_name("q", F.col("id")).alias("id"), unknown).unionByName(
        rollouts.select(name("t"), unknown)).unionByName(rollouts.select(name("a"), known))
    edges = graph.extended_graph(nodes, rollouts, competing=(3, 5)).select("src", "dst", "weight")
    spread, _, _ = spread_rewards(every, edges, damping=0.3, tolerance=1e-11)
    return spread.select("id", F.col("reward").isNotNull().alias("clamped"), r6(F.col("value")).alias("value"))


# --- foreign scorers -----------------------------------------------------------


def agreement(data_sources: list, solution_strs: list, ground_truths: list, extra_infos: list) -> list:
    """A scorer as users write it: the share of a prompt's responses that read the same."""
    same, whole = Counter(zip(extra_infos, solution_strs, strict=True)), Counter(extra_infos)
    return [same[e, s] / whole[e] for e, s in zip(extra_infos, solution_strs, strict=True)]


@query("rwd5_external_scorer", ROLLOUTS + """
SELECT query_id, resp_idx, round(count(*) OVER (PARTITION BY query_id, response) / count(*) OVER (PARTITION BY query_id)::DOUBLE, 6) AS reward,
  CAST(NULL AS VARCHAR) AS error FROM rollouts""")
def _(spark, root):
    rows = feeds.rollouts(spark, root).withColumn("extra_info", F.col("query_id").cast("string"))
    scored = external_reward(rows, agreement, [F.col("query_id")])
    return scored.select(F.col("group_key.k0").alias("query_id"), "resp_idx", r6(F.col("reward")).alias("reward"), "error")


# --- neighbour graph by descent --------------------------------------------------


@query("grf14_descent_recall")
def _(spark, root):
    """Across-query neighbours found by descent over all nodes, and their recall on sampled sources; tests ask for 0.9."""
    nodes = rollout_nodes_of(spark, root)
    edges, rounds = descent.descent_edges(nodes, 5, group="query_id")
    edges = cut_lineage(edges, "descent")
    measured = descent.sampled_recall(nodes, edges, 5, group="query_id")
    return measured.withColumns({"edges": F.lit(edges.count()), "rounds": F.lit(rounds)})
