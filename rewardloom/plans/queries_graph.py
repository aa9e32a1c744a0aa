"""Registered queries: graph construction and inference along the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.config import EngineConfig
from rewardloom.functions.vectors import cosine, unit
from rewardloom.operators import graph, knn, propagate
from rewardloom.plans.registry import ROLLOUTS, ctes, query, r6
from rewardloom.session import cut_lineage
from rewardloom.sources import feeds

NODES = ctes("query_nodes")
RNODES = ctes("rollout_nodes")

SIMS = """,
sims AS (SELECT a.id AS src, b.id AS dst, a.domain AS sd, b.domain AS dd, a.is_memory AS sm, b.is_memory AS dm,
  list_cosine_similarity(a.embedding, b.embedding) AS sim FROM query_nodes a, query_nodes b)
"""


def top_k(where: str, k: int, table: str = "sims") -> str:
    return (
        f"SELECT src, dst, round(sim, 6) + 0.0::DOUBLE AS sim FROM {table} WHERE {where} "
        f"QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= {k}"
    )


def nodes_of(spark, root):
    return feeds.query_nodes(spark, root).withColumnRenamed("query_id", "id")


def rollout_nodes_of(spark, root):
    return feeds.rollout_nodes(spark, root).withColumnRenamed("node_id", "id")


def shown(edges):
    return edges.withColumn("sim", r6(F.col("sim")))


# --- structural edges --------------------------------------------------------

_STRUCT = {
    "generates": ("'query'", "'q:' || query_id", "'answer'", "'a:' || query_id || ':' || resp_idx"),
    "generates_reasoning": ("'query'", "'q:' || query_id", "'think'", "'t:' || query_id || ':' || resp_idx"),
    "leads_to": ("'think'", "'t:' || query_id || ':' || resp_idx", "'answer'", "'a:' || query_id || ':' || resp_idx"),
}


def struct_sql(kinds, reverse: bool) -> str:
    out = []
    for kind in kinds:
        st, s, dt, d = _STRUCT[kind]
        if reverse:
            out.append(f"SELECT {dt} AS src_type, {d} AS src, 'rev_{kind}' AS edge_type, {st} AS dst_type, {s} AS dst, 1.0::DOUBLE AS weight FROM rollouts")
        else:
            out.append(f"SELECT {st} AS src_type, {s} AS src, '{kind}' AS edge_type, {dt} AS dst_type, {d} AS dst, 1.0::DOUBLE AS weight FROM rollouts")
    return " UNION ALL ".join(out)


@query("grf1_generate_edges", ROLLOUTS + struct_sql(["generates", "generates_reasoning"], False))
def _(spark, root):
    return graph.structural_edges(
        feeds.rollouts(spark, root), kinds=("generates", "generates_reasoning"), reverse=False)


@query("grf2_leads_to_edges", ROLLOUTS + struct_sql(["leads_to"], False))
def _(spark, root):
    return graph.structural_edges(feeds.rollouts(spark, root), kinds=("leads_to",), reverse=False)


@query("grf3_reverse_edges", ROLLOUTS + struct_sql(list(_STRUCT), True))
def _(spark, root):
    edges = graph.structural_edges(feeds.rollouts(spark, root))
    return edges.where(F.col("edge_type").startswith("rev_"))


@query("grf4_cosine_similarity", ctes("rollout_nodes", "query_nodes") + """
SELECT r.id, round(list_cosine_similarity(r.embedding, q.embedding), 6) + 0.0::DOUBLE AS sim
FROM rollout_nodes r JOIN query_nodes q ON q.id = r.query_id""")
def _(spark, root):
    owners = nodes_of(spark, root).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    rows = rollout_nodes_of(spark, root).join(owners, "query_id")
    return rows.select("id", r6(cosine(F.col("embedding"), F.col("q"))).alias("sim"))


# --- neighbour edges ---------------------------------------------------------

@query("grf5_domain_knn", NODES + SIMS + top_k("sd = dd AND src <> dst", 15))
def _(spark, root):
    return shown(graph.similar_in_domain(nodes_of(spark, root), 15))


@query("join5_memory_knn", NODES + SIMS + top_k("sm AND dm AND src <> dst AND sim > -1", 5))
def _(spark, root):
    return shown(graph.similar_in_memory(nodes_of(spark, root), 5))


@query("join6_new_to_memory_knn", NODES + SIMS + top_k("NOT sm AND dm AND sim > -1", 5))
def _(spark, root):
    return shown(graph.similar_to_memory(nodes_of(spark, root), 5))


@query("grf6_memory_knn", NODES + SIMS + top_k("sm AND dm AND src <> dst AND sim > -1", 7))
def _(spark, root):
    return shown(graph.similar_in_memory(nodes_of(spark, root)))


@query("grf7_new_to_memory_knn", NODES + SIMS + top_k("NOT sm AND dm AND sim > -1", 7))
def _(spark, root):
    return shown(graph.similar_to_memory(nodes_of(spark, root)))


@query("grf8_same_domain_knn", NODES + SIMS + top_k("sd = dd AND dm AND src <> dst AND sim > -1", 7))
def _(spark, root):
    return shown(graph.remembered(nodes_of(spark, root), same_domain=True))


_RSIMS = """,
rsims AS (SELECT a.id AS src, b.id AS dst, a.query_id AS sq, b.query_id AS dq,
  list_cosine_similarity(a.embedding, b.embedding) AS sim FROM rollout_nodes a, rollout_nodes b WHERE a.id <> b.id)
"""


@query("grf9_think_knn_in_query", RNODES + _RSIMS + top_k("sq = dq", 3, "rsims"))
def _(spark, root):
    return shown(graph.competing_in_query(rollout_nodes_of(spark, root), 3))


@query("grf9_think_clique", RNODES + _RSIMS + """
SELECT src AS id, count(*) AS degree, round(avg(sim), 6) + 0.0::DOUBLE AS mean_sim FROM rsims WHERE sq = dq GROUP BY 1""")
def _(spark, root):
    means = graph.clique_means(rollout_nodes_of(spark, root), "query_id")
    return means.where("degree > 0").select("id", "degree", r6(F.col("mean_sim")).alias("mean_sim"))


@query("grf10_think_knn_across_queries", RNODES + _RSIMS + top_k("sq <> dq", 5, "rsims"))
def _(spark, root):
    return shown(graph.competing_across_queries(rollout_nodes_of(spark, root), 5))


@query("grf11_answer_clique", ROLLOUTS + """
SELECT query_id, resp_idx AS id, count(*) OVER (PARTITION BY query_id) AS members,
  count(*) OVER (PARTITION BY query_id) - 1 AS degree, 'competes_with' AS edge_type FROM rollouts""")
def _(spark, root):
    nodes = feeds.rollouts(spark, root).select("query_id", F.col("resp_idx").alias("id"))
    return graph.clique_degrees(nodes, "query_id", "competes_with")


@query("grf12_extended_graph", ctes("query_nodes", "rollout_nodes") + SIMS + _RSIMS.rstrip() + """,
knn AS (SELECT * FROM sims WHERE dm AND src <> dst AND sim > -1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 7)
SELECT 'similar_to' AS edge_type, count(*) AS edges, count(DISTINCT src) AS sources, round(sum(sim), 6) AS weight FROM knn
UNION ALL SELECT unnest(['generates', 'rev_generates', 'generates_reasoning', 'rev_generates_reasoning', 'leads_to', 'rev_leads_to']), edges, sources, weight
FROM (SELECT count(*) AS edges, CAST(0 AS BIGINT) AS sources, count(*)::DOUBLE AS weight FROM rollout_nodes)
UNION ALL SELECT 'competes_with', count(*), 0, round(sum(sim), 6) FROM (
  SELECT src, sim FROM rsims WHERE sq = dq QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 3
  UNION ALL SELECT src, sim FROM rsims WHERE sq <> dq QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5)""")
def _(spark, root):
    edges = graph.extended_graph(nodes_of(spark, root), rollout_nodes_of(spark, root), competing=(3, 5))
    per_source = edges.groupBy("edge_type", "src").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return per_source.groupBy("edge_type").agg(
        F.sum("n").alias("edges"), F.count("*").alias("s"), r6(F.sum("w")).alias("weight")).select(
        "edge_type", "edges", F.when(F.col("edge_type") == "similar_to", F.col("s")).otherwise(F.lit(0).cast("bigint")).alias("sources"), "weight")


@query("grf12_extended_nodes", ctes("query_nodes", "rollout_nodes") + """
SELECT node_type, is_memory, count(*) AS nodes FROM (
  SELECT 'query' AS node_type, is_memory FROM query_nodes
  UNION ALL SELECT unnest(['think', 'answer']), q.is_memory FROM rollout_nodes r JOIN query_nodes q ON q.id = r.query_id) GROUP BY ALL""")
def _(spark, root):
    nodes = graph.extended_nodes(nodes_of(spark, root), rollout_nodes_of(spark, root))
    return nodes.groupBy("node_type", "is_memory").agg(F.count("*").alias("nodes"))


@query("grf13_domain_index", NODES + """
SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY id) - 1 AS local_index FROM query_nodes""")
def _(spark, root):
    return graph.domain_index(nodes_of(spark, root)).select("domain", "id", "local_index")


def _approximate(spark, root):
    """Recall of as few probes as are enough, and of all."""
    nodes = nodes_of(spark, root)
    memory, new = nodes.where("is_memory"), nodes.where(~F.col("is_memory"))
    exact = cut_lineage(knn.knn_edges(new, memory, 7))
    index = knn.search_index(memory, 7)
    found = knn.edges_for_recall(new, memory, 7, index=index), (knn.approximate_edges(new, memory, 7, probes=1 << 30, index=index), 1 << 30)
    return [knn.recall(exact, edges).withColumn("probes", F.lit(probes)) for edges, probes in found]


@query("grf14_approximate_knn", NODES + """
SELECT probes, 7 * (SELECT count(*) FROM query_nodes WHERE NOT is_memory) AS exact_edges, true AS enough
FROM (SELECT unnest(['few', 'all']) AS probes)""")
def _(spark, root):
    """Nine tenths of the neighbours at least with a few probes, each of them with all; rewards use exact search."""
    few, every = _approximate(spark, root)
    named = few.select(F.lit("few").alias("probes"), "exact_edges", (F.col("recall") >= 0.9).alias("enough"))
    return named.unionByName(every.select(F.lit("all").alias("probes"), "exact_edges", (F.col("recall") == 1).alias("enough")))


@query("grf14_approximate_recall")
def _(spark, root):
    """The figures behind grf14_approximate_knn; the cells depend on hashes of ids, so SQL states none."""
    few, every = _approximate(spark, root)
    return few.unionByName(every)


@query("grf15_edge_statistics", ROLLOUTS + """
SELECT edge_type, edges, sources, round(edges / sources::DOUBLE, 6) AS avg_degree, CASE WHEN sources = edges THEN 1 ELSE max_degree END AS max_degree FROM (
  SELECT unnest(['generates', 'generates_reasoning']) AS edge_type, (SELECT count(*) FROM rollouts) AS edges,
    (SELECT count(DISTINCT query_id) FROM rollouts) AS sources, (SELECT max(n) FROM (SELECT count(*) AS n FROM rollouts GROUP BY query_id)) AS max_degree
  UNION ALL SELECT unnest(['rev_generates', 'rev_generates_reasoning', 'leads_to', 'rev_leads_to']), count(*), count(*), 1 FROM rollouts)""")
def _(spark, root):
    return graph.structural_statistics(feeds.rollouts(spark, root))


@query("grf15_domain_mix", NODES + SIMS + """,
e AS (SELECT * FROM sims WHERE sm AND dm AND src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 7)
SELECT sd AS src_domain, dd AS dst_domain, count(*) AS edges FROM e GROUP BY ALL""")
def _(spark, root):
    nodes = nodes_of(spark, root)
    return knn.degree_mix(graph.similar_in_memory(nodes), nodes)


# --- the same searches over cells and blocks, as for candidates beyond a broadcast ---

BLOCKS = EngineConfig(broadcast_bytes=1, block_rows=256)


@query("grf5_domain_knn_blocks", NODES + SIMS + top_k("sd = dd AND src <> dst", 15))
def _(spark, root):
    return shown(graph.similar_in_domain(nodes_of(spark, root), 15, BLOCKS))


@query("grf6_memory_knn_blocks", NODES + SIMS + top_k("sm AND dm AND src <> dst AND sim > -1", 7))
def _(spark, root):
    return shown(graph.similar_in_memory(nodes_of(spark, root), config=BLOCKS))


@query("grf7_new_to_memory_knn_blocks", NODES + SIMS + top_k("NOT sm AND dm AND sim > -1", 7))
def _(spark, root):
    return shown(graph.similar_to_memory(nodes_of(spark, root), config=BLOCKS))


@query("grf8_same_domain_knn_blocks", NODES + SIMS + top_k("sd = dd AND dm AND src <> dst AND sim > -1", 7))
def _(spark, root):
    return shown(graph.remembered(nodes_of(spark, root), same_domain=True, config=BLOCKS))


@query("grf10_think_knn_blocks", RNODES + _RSIMS + top_k("sq <> dq", 5, "rsims"))
def _(spark, root):
    return shown(graph.competing_across_queries(rollout_nodes_of(spark, root), 5, BLOCKS))


# --- inference ---------------------------------------------------------------

_NEAR = """,
near AS (SELECT * FROM sims WHERE NOT sm AND dm QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 7),
"""
_VEC = "list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))))"
DIMENSIONS = 64


# Rollouts: each vector also stands for two rollouts of query vec_id.
_PROP = NODES + SIMS + _NEAR + f"""
r AS (SELECT vec_id AS query_id, resp AS resp_idx, is_memory, CASE WHEN (vec_id + label + resp) % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
  list_transform({_VEC}, lambda x: CASE WHEN resp = 0 THEN x ELSE -x END) AS f
  FROM (SELECT e.*, n.is_memory, unnest([0, 1]) AS resp FROM embeddings e JOIN query_nodes n ON n.id = e.vec_id) e),
inferred AS (
  SELECT a.query_id, a.resp_idx,
    round(sum(greatest(sim, 0) * (1 + list_dot_product(a.f, s.f)) * s.reward) / nullif(sum(greatest(sim, 0) * (1 + list_dot_product(a.f, s.f))), 0), 9) AS prob
  FROM r a JOIN near e ON e.src = a.query_id JOIN r s ON s.query_id = e.dst WHERE NOT a.is_memory GROUP BY ALL)
"""


def _propagation_rollouts(spark, root):
    nodes = nodes_of(spark, root)
    vec = unit(F.col("embedding"))
    each = nodes.select(
        F.col("id").alias("query_id"), "is_memory", "label", vec.alias("v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("resp_idx"))
    return each.select(
        "query_id", F.col("resp_idx").cast("bigint").alias("resp_idx"), "is_memory",
        F.when((F.col("query_id") + F.col("label") + F.col("resp_idx")) % 3 == 0, 1.0).otherwise(0.0).alias("reward"),
        F.when(F.col("resp_idx") == 0, F.col("v")).otherwise(F.transform("v", lambda x: -x)).alias("features"))


@query("prp1_propagated_reward", _PROP + """
SELECT query_id, CAST(resp_idx AS BIGINT) AS resp_idx, round(prob, 6) AS prob, CASE WHEN prob > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM inferred""")
def _(spark, root):
    rows = _propagation_rollouts(spark, root)
    edges = graph.similar_to_memory(nodes_of(spark, root))
    new = rows.where(~F.col("is_memory")).drop("reward")
    out = propagate.propagate(new, rows.where("is_memory"), edges, DIMENSIONS)
    return out.select("query_id", "resp_idx", r6(F.col("prob")).alias("prob"), "reward")


@query("prp7_transductive", NODES + SIMS + f""",
near AS (SELECT * FROM sims WHERE dm AND src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 7),
r AS (SELECT vec_id AS query_id, resp AS resp_idx, is_memory, CASE WHEN (vec_id + label + resp) % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward,
  list_transform({_VEC}, lambda x: CASE WHEN resp = 0 THEN x ELSE -x END) AS f
  FROM (SELECT e.*, n.is_memory, unnest([0, 1]) AS resp FROM embeddings e JOIN query_nodes n ON n.id = e.vec_id) e),
p AS (SELECT a.query_id, a.resp_idx, a.is_memory, a.reward AS label,
    round(sum(greatest(sim, 0) * (1 + list_dot_product(a.f, s.f)) * s.reward) / nullif(sum(greatest(sim, 0) * (1 + list_dot_product(a.f, s.f))), 0), 9) AS prob
  FROM r a JOIN near e ON e.src = a.query_id JOIN r s ON s.query_id = e.dst GROUP BY ALL)
SELECT CASE WHEN is_memory THEN 'train' ELSE 'valid' END AS split, count(*) AS n, round(avg(prob), 6) AS mean_prob,
  count(*) FILTER ((prob > 0.5) = (label > 0.5)) AS agreeing FROM p GROUP BY 1""")
def _(spark, root):
    rows = _propagation_rollouts(spark, root).withColumn("split", F.when(F.col("is_memory"), "train").otherwise("valid"))
    edges = graph.remembered(nodes_of(spark, root))
    out = propagate.transductive(rows, edges, DIMENSIONS)
    return out.groupBy("split").agg(
        F.count("*").alias("n"), r6(F.avg("prob")).alias("mean_prob"),
        F.count_if((F.col("prob") > 0.5) == (F.col("label") > 0.5)).alias("agreeing"))


# A graph with two edge types over the vectors: neighbours and ring successors.
_EDGES = SIMS + """,
edges AS (
  SELECT src, dst, 'similar_to' AS edge_type, sim AS weight FROM (SELECT * FROM sims WHERE src <> dst AND sd = dd
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5)
  UNION ALL SELECT id, id + 1, 'leads_to', 0.5::DOUBLE FROM query_nodes WHERE id + 1 IN (SELECT id FROM query_nodes)),
xy AS (SELECT id, unnest(range(1, len(embedding) + 1)) AS d, unnest(embedding) AS x FROM query_nodes),
"""


def two_type_edges(spark, root):
    nodes = nodes_of(spark, root)
    near = graph.similar_in_domain(nodes, 5).select("src", "dst", F.lit("similar_to").alias("edge_type"), F.col("sim").alias("weight"))
    follow = nodes.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("leads_to").alias("edge_type"), F.lit(0.5).alias("weight"))
    return near.unionByName(follow.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))


def vectors_of(spark, root):
    return nodes_of(spark, root).select("id", F.col("embedding").alias("vec"))


def exploded(layer):
    return layer.select("id", F.posexplode("vec").alias("d", "value")).select(
        "id", (F.col("d") + 1).cast("bigint").alias("d"), r6(F.col("value")).alias("value"))


@query("prp2_message_layer", NODES + _EDGES + """
t AS (SELECT dst, edge_type, d, avg(x) AS x FROM edges JOIN xy ON src = id GROUP BY ALL)
SELECT dst AS id, d, round(greatest(avg(x), 0), 6) + 0.0::DOUBLE AS value FROM t GROUP BY ALL""")
def _(spark, root):
    return exploded(propagate.message_layer(vectors_of(spark, root), two_type_edges(spark, root)))


@query("prp3_attention", NODES + _EDGES.rstrip().rstrip(",") + """,
loops AS (SELECT * FROM edges UNION ALL SELECT DISTINCT dst, dst, 'similar_to', 1.0::DOUBLE FROM edges WHERE edge_type = 'similar_to')
SELECT src, dst, edge_type, round(exp(weight / 0.5) / sum(exp(weight / 0.5)) OVER (PARTITION BY dst, edge_type), 6) AS attention FROM loops""")
def _(spark, root):
    out = propagate.attention(two_type_edges(spark, root), temperature=0.5)
    return out.withColumn("attention", r6(F.col("attention")))


@query("prp4_message_stack", NODES + _EDGES + """
t1 AS (SELECT dst, avg(x) AS x, d FROM edges JOIN xy ON src = id WHERE edge_type = 'similar_to' GROUP BY dst, d),
s1 AS (SELECT xy.id, xy.d, CASE WHEN t1.x IS NULL THEN xy.x ELSE greatest(t1.x, 0) END AS x FROM xy LEFT JOIN t1 ON t1.dst = xy.id AND t1.d = xy.d),
t2 AS (SELECT dst, d, avg(x) AS x FROM edges JOIN s1 ON src = id WHERE edge_type = 'similar_to' GROUP BY dst, d)
SELECT s1.id, s1.d, round(CASE WHEN t2.x IS NULL THEN s1.x ELSE greatest(t2.x, 0) END, 6) + 0.0::DOUBLE AS value
FROM s1 LEFT JOIN t2 ON t2.dst = s1.id AND t2.d = s1.d""")
def _(spark, root):
    return exploded(propagate.message_stack(
        vectors_of(spark, root), two_type_edges(spark, root), 2, kinds=["similar_to", "absent_type"]))


@query("prp5_dot_product_score", ctes("rollout_nodes", "query_nodes") + """,
s AS (SELECT r.id, list_dot_product(q.embedding, r.embedding) / sqrt(64.0::DOUBLE) + 0.1 AS logit FROM rollout_nodes r JOIN query_nodes q ON q.id = r.query_id)
SELECT id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS prob, CASE WHEN 1 / (1 + exp(-logit)) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM s""")
def _(spark, root):
    owners = nodes_of(spark, root).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    pairs = rollout_nodes_of(spark, root).drop("reward").withColumnRenamed("embedding", "response_vec").join(owners, "query_id")
    scored = propagate.score_pairs(pairs, bias=0.1)
    return scored.select("id", r6(F.col("logit")).alias("logit"), r6(F.col("prob")).alias("prob"), "reward")


# Message passing over all node types of the extended graph.
_EXTENDED = ctes("query_nodes", "rollout_nodes") + SIMS + _RSIMS.rstrip() + """,
all_nodes AS (
  SELECT 'q:' || id AS id, embedding AS vec FROM query_nodes
  UNION ALL SELECT 't:' || query_id || ':' || resp_idx, embedding FROM rollout_nodes
  UNION ALL SELECT 'a:' || query_id || ':' || resp_idx, list_reverse(embedding) FROM rollout_nodes),
ends AS (SELECT id AS vec_id, 'q:' || query_id AS q, 't:' || query_id || ':' || resp_idx AS t, 'a:' || query_id || ':' || resp_idx AS a FROM rollout_nodes),
edges AS (
  SELECT q AS src, a AS dst, 'generates' AS edge_type FROM ends UNION ALL SELECT a, q, 'rev_generates' FROM ends
  UNION ALL SELECT q, t, 'generates_reasoning' FROM ends UNION ALL SELECT t, q, 'rev_generates_reasoning' FROM ends
  UNION ALL SELECT t, a, 'leads_to' FROM ends UNION ALL SELECT a, t, 'rev_leads_to' FROM ends
  UNION ALL SELECT 'q:' || src, 'q:' || dst, 'similar_to' FROM (SELECT * FROM sims WHERE dm AND src <> dst AND sim > -1
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 7)
  UNION ALL SELECT x.t, y.t, 'competes_with' FROM (
    SELECT src, dst FROM rsims WHERE sq = dq QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 3
    UNION ALL SELECT src, dst FROM rsims WHERE sq <> dq QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 5) e
    JOIN ends x ON x.vec_id = e.src JOIN ends y ON y.vec_id = e.dst),
xy AS (SELECT id, unnest(range(1, len(vec) + 1)) AS d, unnest(vec) AS x FROM all_nodes),
typed AS (SELECT dst, edge_type, d, avg(x) AS x FROM edges JOIN xy ON src = id GROUP BY ALL),
layer AS (SELECT dst AS id, d, greatest(avg(x), 0) AS x FROM typed GROUP BY ALL)
"""


def extended_layer(spark, root):
    """One layer over queries, thinks and answers; an answer's vector is its rollout's in reverse."""
    nodes, rollouts = nodes_of(spark, root), rollout_nodes_of(spark, root)
    name = lambda kind: graph.node_name(kind, F.col("query_id"), F.col("resp_idx")).alias("id")
    vectors = (
        nodes.select(graph.node_name("q", F.col("id")).alias("id"), F.col("embedding").alias("vec"))
        .unionByName(rollouts.select(name("t"), F.col("embedding").alias("vec")))
        .unionByName(rollouts.select(name("a"), F.reverse("embedding").alias("vec"))))
    return propagate.message_layer(vectors, graph.extended_graph(nodes, rollouts, competing=(3, 5)))


@query("prp2_extended_layer", _EXTENDED + """
SELECT id, d, round(x, 6) + 0.0::DOUBLE AS value FROM layer""")
def _(spark, root):
    return exploded(extended_layer(spark, root))


@query("prp5_extended_score", _EXTENDED + """,
s AS (SELECT e.vec_id, sum(q.x * a.x) / sqrt(64.0::DOUBLE) AS logit
  FROM ends e JOIN layer q ON q.id = e.q JOIN layer a ON a.id = e.a AND a.d = q.d GROUP BY 1)
SELECT vec_id AS id, round(logit, 6) AS logit, round(1 / (1 + exp(-logit)), 6) AS prob FROM s""")
def _(spark, root):
    layer = cut_lineage(extended_layer(spark, root))
    rollouts = rollout_nodes_of(spark, root).select(
        F.col("id").alias("vec_id"), graph.node_name("q", F.col("query_id")).alias("q"),
        graph.node_name("a", F.col("query_id"), F.col("resp_idx")).alias("a"))
    pairs = rollouts.join(layer.select(F.col("id").alias("q"), F.col("vec").alias("query_vec")), "q").join(
        layer.select(F.col("id").alias("a"), F.col("vec").alias("response_vec")), "a")
    scored = propagate.score_pairs(pairs)
    return scored.select(F.col("vec_id").alias("id"), r6(F.col("logit")).alias("logit"), r6(F.col("prob")).alias("prob"))


@query("prp6_fitted_rewards")
def _(spark, root):
    """Probability and prediction of every rollout; a test compares successes with failures."""
    rows = _propagation_rollouts(spark, root)
    edges = graph.remembered(nodes_of(spark, root))
    labelled = rows.where("is_memory")
    # Read by each pass of the fit and by the prediction: searched once, then stored.
    table = cut_lineage(propagate.neighbour_features(rows, edges, labelled).select(
        "query_id", "resp_idx", "is_memory", "reward", "mean_rate", "weighted_rate", "neighbours",
        *[F.get("features", i).alias(f"f{i}") for i in range(DIMENSIONS)]), "features")
    columns = ["mean_rate", "weighted_rate", "neighbours", *[f"f{i}" for i in range(DIMENSIONS)]]
    model = propagate.fit_rewards(table.where("is_memory"), columns)
    scored = propagate.predict_rewards(model, table)
    return scored.select("query_id", "resp_idx", "is_memory", "reward", r6(F.col("prob")).alias("prob"), "predicted")
