"""Registered queries: rewards, routing, features and the mixed reward."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.functions.domains import gt_only_domain, scoring_domain
from rewardloom.operators import features, routing, scoring
from rewardloom.plans import mixed_reward as mixed
from rewardloom.plans.queries_text import (
    VARIED_SQL, duck_boxed, duck_clean, duck_clean_generalization, duck_hash_answer, duck_letter, duck_number,
    duck_numeric_answer, duck_strip, varied,
)
from rewardloom.plans.registry import ROLLOUTS, ctes, query, r6
from rewardloom.sources import feeds

KEYS = ["query_id", "resp_idx"]
IS_QA = "data_source IN ('mmlu', 'arc_c')"


def duck_math_correct(pred: str, truth: str, clean=duck_clean) -> str:
    """Normalised equality over two text columns; null prediction gives null."""
    p, t = clean(pred), clean(truth)
    pn, tn = duck_number(p), duck_number(t)
    return f"({pn} IS NOT DISTINCT FROM {tn} AND CASE WHEN {pn} IS NULL THEN {p} END IS NOT DISTINCT FROM CASE WHEN {tn} IS NULL THEN {t} END)"


# Predictions first, so that the long expressions stay readable.
SCORED_SQL = VARIED_SQL + f""",
pred AS (
  SELECT *, coalesce({duck_hash_answer('txt')}, {duck_boxed('txt')}) AS m, {duck_letter('txt', 'E', 'D', 'NULL')} AS l FROM varied),
judged AS (
  SELECT *, CASE WHEN m IS NOT NULL AND {duck_math_correct('m', 'ground_truth')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS math_reward,
    CASE WHEN trim(ground_truth) <> '' AND contains('ABCDE', upper(trim(ground_truth))) AND l = upper(trim(ground_truth))
      THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS qa_reward FROM pred)
"""


@query("rwd1_math_reward", SCORED_SQL + "SELECT query_id, resp_idx, math_reward AS reward FROM judged")
def _(spark, root):
    return varied(spark, root).select(*KEYS, scoring.math_reward(F.col("txt"), F.col("ground_truth")).alias("reward"))


@query("rwd1_math_accuracy", ROLLOUTS + f""",
pred AS (SELECT *, coalesce({duck_hash_answer('response')}, {duck_boxed('response')}) AS m FROM rollouts WHERE NOT {IS_QA})
SELECT data_source, count(*) AS rollouts, round(avg(CASE WHEN m IS NOT NULL AND {duck_math_correct('m', 'ground_truth')} THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY 1""")
def _(spark, root):
    rows = feeds.rollouts(spark, root).where(scoring_domain(F.col("data_source")) == "math")
    scored = rows.withColumn("reward", scoring.math_reward(F.col("response"), F.col("ground_truth")))
    return scored.groupBy("data_source").agg(F.count("*").alias("rollouts"), r6(F.avg("reward")).alias("accuracy"))


@query("rwd2_qa_reward", SCORED_SQL + "SELECT query_id, resp_idx, qa_reward AS reward FROM judged")
def _(spark, root):
    return varied(spark, root).select(*KEYS, scoring.qa_reward(F.col("txt"), F.col("ground_truth")).alias("reward"))


def outcomes(spark, root):
    """Recorded test runs: three per rollout, none for every fourth rollout."""
    rows = feeds.rollouts(spark, root).where(F.col("resp_idx") % 4 != 0)
    tests = rows.select(*KEYS, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("test_id"))
    q, r, t = F.col("query_id"), F.col("resp_idx"), F.col("test_id")
    return tests.withColumns({"passed": (q + r + t) % 11 != 0, "seconds": ((q + t) % 7).cast("double")})


@query("rwd3_code_reward", ROLLOUTS + """,
t AS (SELECT query_id, resp_idx, bool_and((query_id + resp_idx + test_id) % 11 <> 0 AND (query_id + test_id) % 7 <= 5) AS ok
  FROM rollouts, (SELECT unnest([0, 1, 2]) AS test_id) WHERE resp_idx % 4 <> 0 GROUP BY ALL)
SELECT r.query_id, r.resp_idx, CASE WHEN t.ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
FROM rollouts r LEFT JOIN t ON r.query_id = t.query_id AND r.resp_idx = t.resp_idx""")
def _(spark, root):
    rows = feeds.rollouts(spark, root).select(*KEYS)
    return scoring.score_code(rows, outcomes(spark, root), KEYS).select(*KEYS, "reward")


@query("rwd4_domain_dispatch", SCORED_SQL + f"""
SELECT query_id, resp_idx, CASE WHEN resp_idx % 13 = 0 THEN 0.0::DOUBLE WHEN {IS_QA} THEN qa_reward ELSE math_reward END AS reward FROM judged""")
def _(spark, root):
    domain = F.when(F.col("resp_idx") % 13 == 0, "unknown").otherwise(scoring_domain(F.col("data_source")))
    return varied(spark, root).select(
        *KEYS, scoring.gt_reward(domain, F.col("txt"), F.col("ground_truth")).alias("reward"))


@query("rwd5_batch_scoring", SCORED_SQL + f"""
SELECT data_source, count(*) AS n, sum(CASE WHEN {IS_QA} THEN qa_reward ELSE math_reward END) AS total FROM judged GROUP BY 1""")
def _(spark, root):
    rows = varied(spark, root).withColumn("domain", gt_only_domain(F.col("data_source")))
    scored = scoring.score_gt(rows, F.col("domain"), F.col("ground_truth"), "txt")
    return scored.groupBy("data_source").agg(F.count("*").alias("n"), F.sum("reward").alias("total"))


@query("rwd6_answer_default", ctes("queries", "rollouts") + """
SELECT query_id, resp_idx, CASE resp_idx % 3 WHEN 0 THEN ground_truth WHEN 1 THEN '' ELSE 'own' END AS truth FROM rollouts""")
def _(spark, root):
    shape = F.col("resp_idx") % 3
    extra = F.when(shape == 0, '{"index": 1}').when(shape == 1, '{"answer": ""}').otherwise('{"answer": "own"}')
    rows = feeds.rollouts(spark, root).withColumn("extra", routing.parse_extra(extra))
    return rows.select(*KEYS, routing.answer_or(F.col("extra"), F.col("ground_truth")).alias("truth"))


@query("rwd7_evaluation", VARIED_SQL + f""",
pred AS (SELECT *, coalesce({duck_hash_answer('txt')}, {duck_boxed('txt')}) AS m, {duck_letter('txt', 'E', 'D', 'NULL')} AS l,
  'Option ' || ground_truth AS g FROM varied)
SELECT query_id, resp_idx, coalesce(CASE WHEN {IS_QA} THEN l = regexp_extract(upper(g), '[A-E]', 0)
  ELSE m IS NOT NULL AND {duck_math_correct('m', 'g')} END, false) AS correct FROM pred""")
def _(spark, root):
    truth = F.concat(F.lit("Option "), F.col("ground_truth"))
    return varied(spark, root).select(
        *KEYS, scoring.evaluate(F.col("txt"), F.col("data_source"), truth).alias("correct"))


@query("rwd8_evaluation_generalization", VARIED_SQL + f""",
pred AS (SELECT *, CASE WHEN {IS_QA} THEN 'piqa' ELSE 'numina_math' END AS src,
    coalesce(nullif(rtrim(trim(regexp_extract(txt, '####\\s*([^#\\n][^\\n]*?)(?:\\s*####|\\s*$)', 1)), '.'), ''), {duck_boxed('txt')}) AS m,
    {duck_letter('txt', 'C', 'B', 'NULL')} AS l FROM varied)
SELECT query_id, resp_idx, coalesce(CASE WHEN src = 'piqa' THEN l = nullif(regexp_extract(ground_truth, '[A-C]', 0), '')
  ELSE m IS NOT NULL AND {duck_math_correct('m', 'ground_truth', duck_clean_generalization)} END, false) AS correct FROM pred""")
def _(spark, root):
    source = F.when(F.col("data_source").isin("mmlu", "arc_c"), "piqa").otherwise("numina_math")
    return varied(spark, root).select(
        *KEYS, scoring.evaluate_generalization(F.col("txt"), source, F.col("ground_truth")).alias("correct"))


# --- routing -----------------------------------------------------------------

@query("rte1_prompt_key", ctes("queries", "rollouts", "extra") + "SELECT query_id, resp_idx, prompt_key FROM extra")
def _(spark, root):
    rows = feeds.rollouts_with_extra(spark, root).withColumn("extra", routing.parse_extra(F.col("extra_info")))
    return rows.select(
        *KEYS, routing.prompt_key(F.col("extra"), F.col("data_source"), F.col("resp_idx")).alias("prompt_key"))


@query("rte2_group_routes", ctes("queries", "rollouts", "extra") + """
SELECT prompt_key, count(*) AS items, CASE WHEN min_by(query_id, resp_idx) % 5 = 0 THEN true ELSE false END AS use_gt
FROM extra GROUP BY 1""")
def _(spark, root):
    rows = feeds.rollouts_with_extra(spark, root).withColumn("extra", routing.parse_extra(F.col("extra_info")))
    extra = F.col("extra")
    keyed = rows.select(
        "data_source", "resp_idx", routing.entry(extra, "index").alias("index"),
        routing.entry(extra, "problem_id").alias("problem_id"),
        routing.prompt_key(extra, F.col("data_source"), F.col("resp_idx")).alias("prompt_key"))
    return routing.route_prompts(keyed, feeds.gt_ids(spark, root), ["prompt_key"], "resp_idx").select(
        "prompt_key", "items", "use_gt")


_RTE3 = """
WITH t AS (SELECT doc_id, ['piqa', 'gsm8k', 'mmlu', 'apps_x'][CAST(doc_id % 4 AS INTEGER) + 1] AS name FROM documents)
SELECT doc_id, name, doc_id % 3 = 0 AND name <> 'piqa' AND name <> 'apps_x' AS use_gt, doc_id % 3 = 0 AND name <> 'apps_x' AS use_gt_fixed FROM t"""


@query("rte3_route_predicate", _RTE3)
def _(spark, root):
    names = ["piqa", "gsm8k", "mmlu", "apps_x"]
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = feeds.table(spark, root, "documents").select(
        "doc_id", picked.alias("data_source"), F.create_map(F.lit("index"), F.col("doc_id").cast("string")).alias("extra"))
    listed = rows.where((F.col("doc_id") % 3 == 0) & (F.col("data_source") != "apps_x"))
    ids = routing.identified(listed, F.col("extra")).select("dataset", "identifier")
    rows = rows.select("doc_id", "data_source", routing.entry(F.col("extra"), "index").alias("index"),
                       F.lit(None).cast("string").alias("problem_id"))
    order, keys = "doc_id", ["doc_id"]
    published = routing.route_prompts(rows, ids, keys, order)
    fixed = routing.route_prompts(rows, ids, keys, order, reference_families=False)
    return published.select("doc_id", F.col("data_source").alias("name"), "use_gt").join(
        fixed.select("doc_id", F.col("use_gt").alias("use_gt_fixed")), "doc_id")


@query("rte4_routing_stats", ctes("queries", "rollouts") + """,
c AS (SELECT count(*) FILTER (query_id % 5 = 0) AS g, count(*) FILTER (query_id % 5 <> 0) AS n FROM rollouts)
SELECT g AS gt_count, n AS gnn_count, round(g * 100.0::DOUBLE / (g + n), 6) AS gt_percentage, round(n * 100.0::DOUBLE / (g + n), 6) AS gnn_percentage FROM c""")
def _(spark, root):
    stats = routing.routing_stats(feeds.rollouts(spark, root), F.col("query_id") % 5 == 0)
    return stats.withColumns({c: r6(F.col(c)) for c in ("gt_percentage", "gnn_percentage")})


_RTE5 = """
WITH seen AS (SELECT event_type AS dataset, user_id AS index, min(event_id) AS pos FROM events GROUP BY ALL),
limits AS (SELECT event_type AS dataset, count(DISTINCT user_id) AS n_parquet,
  count(DISTINCT CASE WHEN value > 100 THEN user_id END) AS n_cache FROM events GROUP BY 1),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos) AS rank FROM seen)
  JOIN limits USING (dataset) WHERE rank <= least(n_parquet, n_cache))
"""


@query("rte5_gt_identifiers", _RTE5 + "SELECT dataset, index, rank FROM ranked")
def _(spark, root):
    return _gt_identifiers(spark, root).select("dataset", "index", "rank")


@query("rte5_gt_coverage", _RTE5 + """
SELECT dataset, count(*) AS n_total, round(count(*) / max(n_parquet)::DOUBLE * 100, 6) AS coverage FROM ranked GROUP BY 1""")
def _(spark, root):
    return routing.gt_coverage(_gt_identifiers(spark, root))


def _gt_identifiers(spark, root):
    events = feeds.table(spark, root, "events").select(
        F.col("event_type").alias("dataset"), F.col("user_id").alias("index"), F.col("event_id").alias("pos"), "value")
    limits = events.groupBy("dataset").agg(
        F.count_distinct("index").alias("n_parquet"),
        F.count_distinct(F.when(F.col("value") > 100, F.col("index"))).alias("n_cache"))
    return routing.gt_identifiers(events, limits)


_MODES = ctes("queries") + """,
m AS (SELECT 'full' AS mode, * FROM queries UNION ALL SELECT 'mix', * FROM queries
  UNION ALL SELECT 'partial_gt', * FROM queries WHERE query_id % 5 = 0)
"""


def _modes(spark, root):
    rows = feeds.queries(spark, root).select(
        "data_source", "query_id", F.col("query_id").cast("string").alias("identifier"))
    return routing.training_modes(rows, feeds.gt_ids(spark, root), ["identifier"])


@query("rte6_training_modes", _MODES + "SELECT mode, query_id, query_id % 5 = 0 AS is_gt FROM m")
def _(spark, root):
    return _modes(spark, root).select("mode", "query_id", "is_gt")


@query("rte6_mode_statistics", _MODES + """,
c AS (SELECT mode, data_source, count(*) AS rows FROM m GROUP BY ALL)
SELECT c.mode, c.data_source, c.rows, round(c.rows * 100.0::DOUBLE / f.rows, 6) AS kept_percent
FROM c JOIN c f ON f.mode = 'full' AND f.data_source = c.data_source""")
def _(spark, root):
    return routing.mode_statistics(_modes(spark, root), "data_source")


@query("rte8_normalised_sources", ctes("queries") + """
SELECT CASE data_source WHEN 'gsm_symbolic_main' THEN 'gsm_symbolic' ELSE data_source END AS data_source, count(*) AS n FROM queries GROUP BY 1""")
def _(spark, root):
    return routing.storage_source(feeds.queries(spark, root)).groupBy("data_source").agg(F.count("*").alias("n"))


# --- features ----------------------------------------------------------------

FEATURES_SQL = ROLLOUTS + f""",
parsed AS (SELECT *, CASE WHEN {IS_QA} THEN NULL ELSE {duck_numeric_answer('response')} END AS answer FROM rollouts),
votes AS (SELECT data_source, query_id, round(answer, 2) AS v, count(*) AS c, min(resp_idx) AS f FROM parsed WHERE answer IS NOT NULL GROUP BY ALL),
agreed AS (SELECT query_id, v AS consensus, c AS support FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f) = 1),
featured AS (
  SELECT p.*, a.consensus, a.support,
    CASE WHEN answer IS NULL THEN 0.0::DOUBLE ELSE greatest(-1, least(1, sign(answer) * ln(1 + abs(answer)) / 20)) END AS f1,
    CASE WHEN answer IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS f2,
    CASE WHEN answer IS NOT NULL AND consensus <> 0 AND abs(round(answer, 2) - consensus) < 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f3
  FROM parsed p LEFT JOIN agreed a ON p.query_id = a.query_id)
"""


def featured(spark, root):
    return features.answer_features(
        feeds.rollouts(spark, root), ["data_source", "query_id"], scoring_domain(F.col("data_source")))


@query("fea1_answer_features", FEATURES_SQL + """
SELECT query_id, resp_idx, round(f1, 6) + 0.0::DOUBLE AS value, f2 AS valid, f3 AS agrees FROM featured""")
def _(spark, root):
    f = [F.get("answer_features", i) for i in range(3)]
    return featured(spark, root).select(*KEYS, r6(f[0]).alias("value"), f[1].alias("valid"), f[2].alias("agrees"))


@query("fea2_consensus", FEATURES_SQL + "SELECT query_id, consensus, support FROM agreed")
def _(spark, root):
    rows = feeds.rollouts(spark, root).where(scoring_domain(F.col("data_source")) == "math")
    parsed = rows.withColumn("answer", features.numeric_answer(F.col("response")))
    return features.consensus(parsed, ["query_id"]).where("consensus is not null").select("query_id", "consensus", "support")


@query("fea3_empty_features", ROLLOUTS + f"""
SELECT query_id, resp_idx, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS f2, 0.0::DOUBLE AS f3 FROM rollouts WHERE {IS_QA}""")
def _(spark, root):
    rows = feeds.rollouts(spark, root).where(F.col("data_source").isin("mmlu", "arc_c"))
    made = features.answer_features(rows, ["data_source", "query_id"], scoring_domain(F.col("data_source")))
    return made.select(*KEYS, *[F.get("answer_features", i).alias(f"f{i + 1}") for i in range(3)])


@query("fea4_aligned_features", """
SELECT vec_id, CAST(64 AS INTEGER) AS size, round(CASE WHEN vec_id % 64 + 1 > 3 THEN embedding[4]::DOUBLE ELSE 0 END, 6) + 0.0::DOUBLE AS fourth,
  round(list_sum(CAST(embedding AS DOUBLE[])[1:vec_id % 64 + 1]), 6) + 0.0::DOUBLE AS total FROM embeddings""")
def _(spark, root):
    rows = feeds.table(spark, root, "embeddings").select("vec_id", F.slice(
        F.col("embedding").cast("array<double>"), F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("answer_features"))
    fitted = features.align_features(rows)
    vec = F.col("answer_features")
    return fitted.select(
        "vec_id", F.size(vec).alias("size"), r6(F.get(vec, 3)).alias("fourth"),
        r6(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("fea5_self_consistency", ROLLOUTS + f""",
parsed AS (SELECT *, {duck_numeric_answer('response')} AS answer FROM rollouts),
votes AS (SELECT query_id, round(answer, 2) AS v, count(*) AS c, min(resp_idx) AS f FROM parsed WHERE answer IS NOT NULL GROUP BY ALL),
agreed AS (SELECT query_id, v AS consensus, c AS support FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f) = 1),
sizes AS (SELECT query_id, count(*) AS n, count(answer) AS k FROM parsed GROUP BY 1)
SELECT s.query_id, consensus, coalesce(support, 0) AS support, n, round(coalesce(support, 0) / n::DOUBLE, 6) AS agreement, round(k / n::DOUBLE, 6) AS valid_rate
FROM sizes s LEFT JOIN agreed a ON s.query_id = a.query_id""")
def _(spark, root):
    report = features.self_consistency(feeds.rollouts(spark, root), ["query_id"])
    return report.withColumns({c: r6(F.col(c)) for c in ("agreement", "valid_rate")})


# --- mixed reward ------------------------------------------------------------



def duck_text_vector(text: str, length: int = mixed.TEXT) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    places = f"list_transform({words}, lambda w: CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % {length})"
    counts = ", ".join(f"len(list_filter(p, lambda x: x = {i}))::DOUBLE" for i in range(length))
    counted = f"list_transform([{places}], lambda p: [{counts}])[1]"
    divided = "list_transform(v, lambda x: CASE WHEN list_dot_product(v, v) > 0 THEN x / sqrt(list_dot_product(v, v)) ELSE 0.0 END)"
    return f"list_transform([{counted}], lambda v: {divided})[1]"


THINK, ANSWER = (
    f"CASE WHEN contains(response, '####') THEN {duck_strip(f"split_part(response, '####', {n})")} ELSE response END" for n in (1, 2))

MIXED_SQL = ctes("queries", "rollouts", "extra", "query_vectors") + f""",
parsed AS (SELECT *, CASE WHEN {IS_QA} THEN NULL ELSE {duck_numeric_answer('response')} END AS answer,
  coalesce({duck_hash_answer('response')}, {duck_boxed('response')}) AS m, {duck_letter('response', 'E', 'D', 'NULL')} AS l,
  bool_or(NOT is_train) OVER (PARTITION BY batch_id) AS validation FROM extra),
votes AS (SELECT query_id, round(answer, 2) AS v, count(*) AS c, min(resp_idx) AS f FROM parsed WHERE answer IS NOT NULL GROUP BY ALL),
agreed AS (SELECT query_id, v AS consensus FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f) = 1),
raw AS (
  SELECT p.query_id, p.resp_idx, p.data_source,
    CASE WHEN validation THEN 'validation' WHEN p.query_id % 5 = 0 THEN 'gt' ELSE 'graph' END AS route,
    CASE WHEN {IS_QA} THEN CASE WHEN l = ground_truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
         ELSE CASE WHEN m IS NOT NULL AND {duck_math_correct('m', 'ground_truth')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS gt_reward,
    CASE WHEN answer IS NULL THEN [0.0, 0.0, 0.0]::DOUBLE[] ELSE
      [greatest(-1, least(1, sign(answer) * ln(1 + abs(answer)) / 20)), 1.0,
       CASE WHEN consensus <> 0 AND abs(round(answer, 2) - consensus) < 0.01 THEN 1.0 ELSE 0.0 END]::DOUBLE[] END
      || {duck_text_vector(THINK)}
      || {duck_text_vector(ANSWER)} AS f
  FROM parsed p LEFT JOIN agreed a ON p.query_id = a.query_id),
full_rows AS (
  SELECT *, CASE WHEN list_dot_product(f, f) > 0 THEN list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) ELSE f END AS u FROM raw),
memory AS (SELECT * FROM full_rows WHERE route = 'gt'),
vec AS (SELECT query_id, query_id % (SELECT count(*) FROM embeddings) AS vid FROM query_vectors),
sims AS (SELECT a.vec_id AS va, b.vec_id AS vb, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a, embeddings b),
new_vecs AS (SELECT DISTINCT vid FROM vec WHERE query_id IN (SELECT query_id FROM full_rows WHERE route = 'graph')),
near AS (
  SELECT n.vid, mv.query_id AS dst, s.sim FROM new_vecs n JOIN sims s ON s.va = n.vid
  JOIN vec mv ON mv.vid = s.vb AND mv.query_id IN (SELECT query_id FROM memory)
  QUALIFY row_number() OVER (PARTITION BY n.vid ORDER BY s.sim DESC, mv.query_id) <= 7),
edges AS (SELECT v.query_id AS src, dst, sim FROM vec v JOIN near ON near.vid = v.vid),
inferred AS (
  SELECT r.query_id, r.resp_idx,
    round(sum(greatest(sim, 0) * (1 + list_dot_product(r.u, s.u)) * s.gt_reward) / nullif(sum(greatest(sim, 0) * (1 + list_dot_product(r.u, s.u))), 0), 9) AS prob
  FROM full_rows r JOIN edges e ON e.src = r.query_id JOIN memory s ON s.query_id = e.dst
  WHERE r.route = 'graph' GROUP BY ALL),
mixed AS (
  SELECT r.data_source, r.query_id, r.resp_idx,
    CASE WHEN route = 'graph' AND prob IS NOT NULL THEN CASE WHEN prob > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE gt_reward END AS reward,
    CASE WHEN route = 'graph' AND prob IS NOT NULL THEN 'graph' WHEN route = 'graph' THEN 'gt_fallback' ELSE route END AS reward_source,
    round(prob, 6) AS prob
  FROM full_rows r LEFT JOIN inferred i ON r.query_id = i.query_id AND r.resp_idx = i.resp_idx)
"""


def mixed_rewards(spark, root):
    return mixed.mixed_reward(
        feeds.rollouts_with_extra(spark, root), feeds.gt_ids(spark, root), feeds.query_vectors(spark, root))


@query("rwd9_mixed_reward", MIXED_SQL + "SELECT data_source, query_id, resp_idx, reward, reward_source, prob FROM mixed")
def _(spark, root):
    return mixed_rewards(spark, root).withColumn("prob", r6(F.col("prob")))


@query("rwd9_mixed_summary", MIXED_SQL + """
SELECT reward_source, count(*) AS n, round(avg(reward), 6) AS mean_reward FROM mixed GROUP BY 1""")
def _(spark, root):
    return mixed.reward_statistics(mixed_rewards(spark, root))
