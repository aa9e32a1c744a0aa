"""Registered queries: filters, samples, splits, joins, set operations, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.functions.domains import dataset_name, query_identifier, scoring_domain
from rewardloom.functions.vectors import dot
from rewardloom.operators import checks, graph, metrics, ranking, routing, runlog, sampling
from rewardloom.operators.features import answer_features
from rewardloom.plans.registry import ROLLOUTS, ctes, query, r6
from rewardloom.session import cut_lineage
from rewardloom.sources import feeds

SHUFFLED = ctes("queries") + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY md5('42|' || query_id), query_id) AS rank,
         count(*) OVER (PARTITION BY data_source) AS size FROM queries)
"""


# --- filters -----------------------------------------------------------------

@query("flt1_domain_nodes", ctes("query_nodes") + "SELECT id, label FROM query_nodes WHERE domain = 'qa'")
def _(spark, root):
    nodes = feeds.query_nodes(spark, root)
    return graph.domain_nodes(nodes, "qa").select(F.col("query_id").alias("id"), "label")


@query("flt2_partial_gt", ctes("queries", "gt_ids") + """
SELECT q.query_id, q.ground_truth FROM queries q
WHERE EXISTS (SELECT 1 FROM gt_ids g WHERE g.query_id = q.query_id
  AND g.dataset = CASE q.data_source WHEN 'gsm_symbolic_main' THEN 'gsm_symbolic' ELSE q.data_source END)""")
def _(spark, root):
    rows = routing.storage_source(feeds.queries(spark, root)).select(
        F.col("data_source").alias("dataset"), F.col("query_id").cast("string").alias("identifier"),
        "query_id", "ground_truth")
    return routing.in_gt(rows, feeds.gt_ids(spark, root), ["dataset", "identifier"]).select("query_id", "ground_truth")


@query("flt3_unbalanced_braces", ROLLOUTS + """,
t AS (SELECT query_id, resp_idx, response || CASE WHEN resp_idx % 5 = 0 THEN '{' WHEN resp_idx % 7 = 0 THEN '}' ELSE '' END AS txt FROM rollouts)
SELECT query_id, resp_idx, txt FROM t
WHERE length(replace(txt, '{', '')) <> length(replace(txt, '}', ''))""")
def _(spark, root):
    tail = F.when(F.col("resp_idx") % 5 == 0, "{").when(F.col("resp_idx") % 7 == 0, "}").otherwise("")
    rows = feeds.rollouts(spark, root).select("query_id", "resp_idx", F.concat("response", tail).alias("txt"))
    return checks.unbalanced(rows, "txt")


@query("flt4_validation_batches", ctes("queries", "rollouts", "extra") + """
SELECT query_id, resp_idx, bool_or(NOT is_train) OVER (PARTITION BY batch_id) AS validation FROM extra""")
def _(spark, root):
    rows = feeds.rollouts_with_extra(spark, root)
    flagged = rows.withColumn("is_train", routing.is_train(routing.parse_extra(F.col("extra_info"))))
    return routing.gate_batches(flagged, "batch_id").select("query_id", "resp_idx", "validation")


@query("flt5_short_prompts", r"""
SELECT doc_id, len(regexp_split_to_array(text, '\s+')) AS words FROM documents
WHERE len(regexp_split_to_array(text, '\s+')) <= 1024""")
def _(spark, root):
    rows = feeds.spread(feeds.table(spark, root, "documents"))
    return checks.short_prompts(rows, "text", 1024).select(
        "doc_id", F.size(F.split("text", r"\s+", -1)).cast("bigint").alias("words"))


_NAMES = "['cache_a', 'cache_a_train', 'cache_b_valid', 'cache_b', 'cache_unified', 'cache_c_backup', 'other_d'][CAST(doc_id % 7 AS INTEGER) + 1]"


@query("flt6_current_sources", f"""
WITH t AS (SELECT doc_id, {_NAMES} AS name FROM documents)
SELECT doc_id, name FROM t WHERE name IN ('cache_a_train', 'cache_b')""")
def _(spark, root):
    names = ["cache_a", "cache_a_train", "cache_b_valid", "cache_b", "cache_unified", "cache_c_backup", "other_d"]
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = feeds.table(spark, root, "documents").select("doc_id", picked.alias("name"))
    return checks.current_sources(rows, "name", "cache_")


# --- samples and splits ------------------------------------------------------

@query("smp1_dedupe", "SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def _(spark, root):
    rows = feeds.table(spark, root, "documents").select("doc_id", "text")
    return sampling.dedupe(rows, ["text"], ["doc_id"])


@query("smp2_sample_per_group", SHUFFLED + "SELECT data_source, query_id FROM ranked WHERE rank <= 1500")
def _(spark, root):
    rows = feeds.queries(spark, root).select("data_source", "query_id")
    return sampling.sample_per_group(rows, ["data_source"], ["query_id"], 1500)


@query("smp3_split_by_share", SHUFFLED + """
SELECT data_source, query_id, CASE WHEN rank <= floor(size * 0.5) THEN 'train'
  WHEN rank <= floor(size * 0.5) + floor(size * 0.2) THEN 'valid' ELSE 'test' END AS split FROM ranked""")
def _(spark, root):
    return sampling.split_by_share(feeds.queries(spark, root), ["data_source"], ["query_id"]).select(
        "data_source", "query_id", "split")


@query("smp4_split_by_count", SHUFFLED + """,
b AS (SELECT *, CASE WHEN size < 3050 THEN floor(size * 2000 / 3050.0::DOUBLE) ELSE 2000 END AS t,
  CASE WHEN size < 3050 THEN floor(size * 500 / 3050.0::DOUBLE) ELSE 500 END AS v FROM ranked)
SELECT data_source, query_id, CASE WHEN rank <= t THEN 'train' WHEN rank <= t + v THEN 'valid' ELSE 'test' END AS split
FROM b WHERE size < 3050 OR rank <= 3050""")
def _(spark, root):
    return sampling.split_by_count(feeds.queries(spark, root), ["data_source"], ["query_id"], 2000, 500, 550).select(
        "data_source", "query_id", "split")


@query("smp5_nested_subsets", SHUFFLED + """
SELECT data_source, query_id, percent FROM ranked, (SELECT unnest([10, 20, 30, 40, 50, 60, 70]) AS percent)
WHERE rank <= greatest(1, floor(size * percent / 100.0::DOUBLE))""")
def _(spark, root):
    return sampling.nested_subsets(
        feeds.queries(spark, root), ["data_source"], ["query_id"], [10, 20, 30, 40, 50, 60, 70]
    ).select("data_source", "query_id", "percent")


@query("smp6_tenth", SHUFFLED + "SELECT data_source, query_id FROM ranked WHERE rank <= round(size * 0.1::DOUBLE)")
def _(spark, root):
    return sampling.tenth(feeds.queries(spark, root), ["data_source"], ["query_id"]).select("data_source", "query_id")


@query("smp7_first_k", """
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 500""")
def _(spark, root):
    rows = feeds.table(spark, root, "events").select("event_type", "event_id")
    return sampling.first_k(rows, ["event_type"], "event_id", 500)


@query("smp7_prefix_to_match", ctes("queries") + """,
limits AS (SELECT data_source, count(*) AS n FROM queries WHERE query_id % 3 = 0 GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY query_id) AS rank FROM queries)
SELECT r.data_source, query_id, rank FROM ranked r JOIN limits l ON r.data_source = l.data_source WHERE rank <= n""")
def _(spark, root):
    rows = feeds.queries(spark, root)
    other = rows.where(F.col("query_id") % 3 == 0)
    return sampling.prefix_to_match(rows, other, ["data_source"], "query_id").select("data_source", "query_id", "rank")


@query("smp8_split_summary", SHUFFLED + """,
s AS (SELECT data_source, CASE WHEN rank <= floor(size * 0.5) THEN 'train'
  WHEN rank <= floor(size * 0.5) + floor(size * 0.2) THEN 'valid' ELSE 'test' END AS split FROM ranked)
SELECT coalesce(data_source, 'TOTAL') AS scope, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'valid') AS valid, count(*) FILTER (split = 'test') AS test, count(*) AS sampled
FROM s GROUP BY ROLLUP (data_source)""")
def _(spark, root):
    split = sampling.split_by_share(feeds.queries(spark, root), ["data_source"], ["query_id"])
    return sampling.split_summary(split, "data_source")


# --- joins -------------------------------------------------------------------

@query("join1_rollouts_with_truth", ctes("queries") + """
SELECT q.data_source, count(*) AS rollouts, count(DISTINCT l_orderkey) AS queries, max(ground_truth) AS last_truth
FROM lineitem JOIN queries q ON l_orderkey = q.query_id GROUP BY 1""")
def _(spark, root):
    rows = feeds.table(spark, root, "lineitem").select(F.col("l_orderkey").alias("query_id"))
    joined = rows.join(feeds.queries(spark, root), "query_id")
    # Distinct ids per source: first per (source, id), which spreads over all keys.
    per_query = joined.groupBy("data_source", "query_id").agg(
        F.count("*").alias("n"), F.max("ground_truth").alias("truth"))
    return per_query.groupBy("data_source").agg(
        F.sum("n").alias("rollouts"), F.count("*").alias("queries"), F.max("truth").alias("last_truth"))


@query("join2_membership", ctes("queries", "rollouts") + """
SELECT kind, count(*) AS n, CAST(sum(resp_idx % 1000) AS BIGINT) AS checksum FROM (
  SELECT 'semi' AS kind, resp_idx FROM rollouts WHERE query_id % 5 = 0 UNION ALL
  SELECT 'anti', resp_idx FROM rollouts WHERE query_id % 5 <> 0 UNION ALL
  SELECT CASE WHEN query_id % 5 = 0 THEN 'flag_true' ELSE 'flag_false' END, resp_idx FROM rollouts) GROUP BY 1""")
def _(spark, root):
    rows = feeds.rollouts(spark, root).select(
        dataset_name(F.col("data_source")).alias("dataset"), F.col("query_id").cast("string").alias("identifier"), "resp_idx")
    ids, keys = feeds.gt_ids(spark, root), ["dataset", "identifier"]
    semi = routing.in_gt(rows, ids, keys).select(F.lit("semi").alias("kind"), "resp_idx")
    anti = routing.not_in_gt(rows, ids, keys).select(F.lit("anti").alias("kind"), "resp_idx")
    flag = routing.with_gt_flag(rows, ids, keys).select(
        F.when(F.col("in_gt"), "flag_true").otherwise("flag_false").alias("kind"), "resp_idx")
    return semi.unionByName(anti).unionByName(flag).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum(F.col("resp_idx") % 1000).alias("checksum"))


_IDS = "['gsm_symbolic_p1', 'gsm8k', 'humaneval_plus', 'mbpp', 'arc-c', 'numina_math', 'math', 'new_set'][CAST(doc_id % 8 AS INTEGER) + 1]"


@query("join3_query_identifier", f"""
SELECT doc_id, ['gsm_symbolic', 'gsm8k', 'humaneval_plus', 'mbpp', 'arc_c', 'numina_math', 'math', 'new_set'][CAST(doc_id % 8 AS INTEGER) + 1] AS dataset,
  CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'k' || n_chars
       WHEN doc_id % 8 IN (2, 3) THEN CAST(doc_id AS VARCHAR) END AS identifier FROM documents""")
def _(spark, root):
    names = ["gsm_symbolic_p1", "GSM8K", "humaneval_plus", "mbpp", "arc-c", "numina_math", "MATH", "New_Set"]
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 8 + 1).cast("int"))
    shape = F.col("doc_id") % 3
    index = F.when(shape == 0, F.col("n_chars").cast("string")).when(shape == 1, F.concat(F.lit("k"), F.col("n_chars").cast("string")))
    problem = F.concat(F.col("doc_id").cast("string"), F.lit(".0"))
    return feeds.table(spark, root, "documents").select(
        "doc_id", dataset_name(picked).alias("dataset"), query_identifier(picked, index, problem).alias("identifier"))


_GLOBAL = ctes("queries") + """,
ranked AS (SELECT *, row_number() OVER (ORDER BY data_source, query_id) - 1 AS global_index,
  row_number() OVER (PARTITION BY data_source ORDER BY query_id) - 1 AS relative_index FROM queries)
"""


@query("join4_relative_index", _GLOBAL + "SELECT query_id, global_index, relative_index FROM ranked")
def _(spark, root):
    combined = sampling.global_index(feeds.queries(spark, root), "data_source", "query_id")
    offsets = combined.groupBy("data_source").agg(F.min("offset").alias("offset"))
    return routing.relative_index(combined.drop("offset"), "data_source", offsets).select(
        "query_id", "global_index", "relative_index")


@query("rte7_global_index", _GLOBAL + "SELECT data_source, query_id, global_index FROM ranked")
def _(spark, root):
    return sampling.global_index(feeds.queries(spark, root), "data_source", "query_id").select(
        "data_source", "query_id", "global_index")


@query("join7_pairs_per_query", ctes("scored") + """
SELECT a.query_id, count(*) AS pairs, count(*) FILTER (b.prob >= a.prob) AS wrong_pairs,
  round(sum(greatest(0, 0.5::DOUBLE - (a.prob - b.prob))), 6) AS hinge_sum
FROM scored a JOIN scored b ON a.query_id = b.query_id AND a.reward > 0.5 AND b.reward <= 0.5 GROUP BY 1""")
def _(spark, root):
    pairs = metrics.ranking_pairs(feeds.scored(spark, root), "query_id", "prob")
    return pairs.withColumn("hinge_sum", r6(F.col("hinge_sum")))


def three_sources(spark, root):
    rows = feeds.queries(spark, root).select(F.col("data_source").alias("dataset"), F.col("query_id").alias("index"))
    aligned_set = F.col("dataset") == "mmlu"
    return {
        "cache": rows.where(aligned_set | (F.col("index") % 3 != 0)),
        "gt": rows.where(aligned_set | (F.col("index") % 4 != 0)),
        "partial": rows,
    }


_THREE = ctes("queries") + """,
a AS (SELECT data_source AS dataset, query_id AS index, data_source = 'mmlu' OR query_id % 3 <> 0 AS in_cache,
  data_source = 'mmlu' OR query_id % 4 <> 0 AS in_gt, true AS in_partial FROM queries)
"""


@query("join8_presence", _THREE + "SELECT dataset, index, in_cache, in_gt, in_partial FROM a")
def _(spark, root):
    return checks.align_sources(three_sources(spark, root), ["dataset", "index"])


@query("set3_differences", _THREE + """
SELECT dataset, count(*) FILTER (in_cache AND NOT in_gt) AS left_only, count(*) FILTER (in_gt AND NOT in_cache) AS right_only,
  count(*) FILTER (in_cache AND in_gt) AS both FROM a GROUP BY 1""")
def _(spark, root):
    aligned = checks.align_sources(three_sources(spark, root), ["dataset", "index"])
    return checks.difference_counts(aligned, "dataset", "cache", "gt")


@query("set4_alignment", _THREE + """
SELECT dataset, bool_and(in_cache AND in_gt AND in_partial) AS aligned, count(*) AS n_keys FROM a GROUP BY 1""")
def _(spark, root):
    aligned = checks.align_sources(three_sources(spark, root), ["dataset", "index"])
    return checks.aligned_groups(aligned, "dataset", ["cache", "gt", "partial"])


@query("set4_verdict", _THREE + """
SELECT bool_and(ok) AS all_ok, count(*) AS groups FROM (SELECT dataset, bool_and(in_cache AND in_gt AND in_partial) AS ok FROM a GROUP BY 1)""")
def _(spark, root):
    aligned = checks.align_sources(three_sources(spark, root), ["dataset", "index"])
    return checks.verdict(checks.aligned_groups(aligned, "dataset", ["cache", "gt", "partial"]))


_STEPS = ctes("log_lines") + """,
steps AS (SELECT DISTINCT user_id % 7 AS log, event_id % 40 AS step FROM events WHERE event_id % 40 < 5 + 5 * (user_id % 7)),
saved AS (SELECT DISTINCT event_id % 40 AS step FROM events WHERE event_id % 3 <> 1 AND event_id % 40 >= 4)
"""


def steps_of(spark, root):
    events = feeds.table(spark, root, "events")
    step, log = F.col("event_id") % 40, F.col("user_id") % 7
    steps = events.where(step < 5 + 5 * log).select(log.alias("log"), step.alias("step"))
    saved = events.where((F.col("event_id") % 3 != 1) & (step >= 4)).select(step.alias("step"))
    return steps, saved


@query("join9_match_checkpoints", _STEPS + """,
o AS (SELECT log, count(*) AS overlap, (SELECT count(*) FROM saved) AS n_saved FROM steps JOIN saved USING (step) GROUP BY 1)
SELECT *, log = (SELECT log FROM o WHERE overlap >= n_saved * 0.5 ORDER BY overlap DESC, log LIMIT 1) AS is_best FROM o""")
def _(spark, root):
    steps, saved = steps_of(spark, root)
    return runlog.match_checkpoints(steps, saved)


@query("set5_step_intersection", _STEPS + "SELECT log, step FROM steps JOIN saved USING (step)")
def _(spark, root):
    steps, saved = steps_of(spark, root)
    return steps.distinct().join(saved.distinct(), "step", "left_semi").select("log", "step")


@query("join10_triples", ctes("rollout_nodes", "query_nodes") + """
SELECT t.query_id, t.resp_idx, round(list_dot_product(q.embedding, t.embedding), 6) + 0.0::DOUBLE AS query_think,
  round(list_dot_product(t.embedding, list_reverse(t.embedding)), 6) + 0.0::DOUBLE AS think_answer
FROM rollout_nodes t JOIN query_nodes q ON q.id = t.query_id""")
def _(spark, root):
    nodes = feeds.rollout_nodes(spark, root)
    thinks = nodes.select("query_id", "resp_idx", F.col("embedding").alias("think_vec"))
    answers = nodes.select("query_id", "resp_idx", F.reverse("embedding").alias("answer_vec"))
    owners = feeds.query_nodes(spark, root).select("query_id", F.col("embedding").alias("query_vec"))
    return graph.rollout_triples(owners, thinks, answers).select(
        "query_id", "resp_idx", r6(dot(F.col("query_vec"), F.col("think_vec"))).alias("query_think"),
        r6(dot(F.col("think_vec"), F.col("answer_vec"))).alias("think_answer"))


# --- set operations and checks ----------------------------------------------

@query("set1_union_of_splits", """
SELECT source, count(*) AS n FROM (SELECT c_mktsegment AS source FROM customer UNION ALL SELECT o_orderpriority FROM orders
  UNION ALL SELECT p_brand FROM part) GROUP BY 1""")
def _(spark, root):
    pieces = [("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("part", "p_brand")]
    frames = [feeds.table(spark, root, t).select(F.col(c).alias("source")) for t, c in pieces]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("source").agg(F.count("*").alias("n"))


@query("set2_merged_memory", ctes("queries", "rollouts") + """,
m AS (SELECT data_source, query_id, resp_idx, CASE WHEN data_source IN ('mmlu', 'arc_c') THEN 'qa' ELSE 'math' END AS domain,
  CASE WHEN data_source IN ('mmlu', 'arc_c') THEN NULL ELSE
    coalesce(TRY_CAST(replace(nullif(regexp_extract(response, '####\\s*(-?[\\d,]+\\.?\\d*)', 1), ''), ',', '') AS DOUBLE),
      TRY_CAST(replace(nullif(regexp_extract(response, '\\\\boxed\\{([^}]+)\\}', 1), ''), ',', '') AS DOUBLE),
      TRY_CAST(replace(regexp_extract_all(response, '-?[\\d,]+\\.?\\d*')[-1], ',', '') AS DOUBLE)) END AS answer
  FROM rollouts)
SELECT domain, count(*) AS n, count(DISTINCT query_id) AS queries,
  round(sum(CASE WHEN answer IS NULL THEN 0 ELSE greatest(-1, least(1, sign(answer) * ln(1 + abs(answer)) / 20)) END), 6) AS value_sum,
  round(sum(CASE WHEN answer IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS valid_sum FROM m GROUP BY 1""")
def _(spark, root):
    keys = ["data_source", "query_id"]
    featured = answer_features(feeds.rollouts(spark, root), keys, scoring_domain(F.col("data_source")))
    owners = featured.withColumn("domain", scoring_domain(F.col("data_source")))
    per_query = owners.groupBy("domain", "query_id").agg(
        F.count("*").alias("n"), F.sum(F.get("answer_features", 0)).alias("v"), F.sum(F.get("answer_features", 1)).alias("k"))
    return per_query.groupBy("domain").agg(
        F.sum("n").alias("n"), F.count("*").alias("queries"), r6(F.sum("v")).alias("value_sum"), r6(F.sum("k")).alias("valid_sum"))


@query("set6_flag_consistency", SHUFFLED + """,
s AS (SELECT query_id, CASE WHEN rank <= floor(size * 0.5) THEN 'train' WHEN rank <= floor(size * 0.5) + floor(size * 0.2) THEN 'valid'
  ELSE 'test' END AS split FROM ranked)
SELECT split, count(*) FILTER ((query_id % 10 <> 0) <> (split = 'train')) AS wrong, count(*) AS total,
  count(*) FILTER ((query_id % 10 <> 0) <> (split = 'train')) = 0 AS consistent FROM s GROUP BY 1""")
def _(spark, root):
    split = sampling.split_by_share(feeds.queries(spark, root), ["data_source"], ["query_id"])
    return checks.flag_consistency(split, "split", F.col("query_id") % 10 != 0, F.col("split") == "train")


@query("set7_table_fingerprint", ROLLOUTS + "SELECT count(*) AS rows, true AS matches FROM rollouts")
def _(spark, root):
    rows = feeds.rollouts(spark, root)
    return checks.matches_manifest(cut_lineage(rows), checks.table_fingerprint(rows))


@query("agg15_group_sizes", ctes("rollout_nodes") + """
SELECT query_id, count(*) AS n FROM rollout_nodes GROUP BY 1 HAVING count(*) <> 8
UNION ALL SELECT l_orderkey, count(*) FROM lineitem GROUP BY 1 HAVING count(*) <> 8""")
def _(spark, root):
    nodes = checks.wrong_group_sizes(feeds.rollout_nodes(spark, root), ["query_id"], 8)
    lines = feeds.table(spark, root, "lineitem").select(F.col("l_orderkey").alias("query_id"))
    return nodes.unionByName(checks.wrong_group_sizes(lines, ["query_id"], 8))


@query("agg16_leak_report", ctes("queries", "gt_ids") + """
SELECT count(*) AS n_memory, CAST(5000 AS BIGINT) AS "limit", count(*) FILTER (query_id % 7 = 0) AS n_leaked,
  count(*) <= 5000 AND count(*) FILTER (query_id % 7 = 0) = 0 AS ok FROM gt_ids""")
def _(spark, root):
    held_out = feeds.queries(spark, root).where(F.col("query_id") % 7 == 0).select(
        F.col("query_id").cast("string").alias("identifier"))
    return checks.leak_report(feeds.gt_ids(spark, root), held_out, ["identifier"], 5000)


@query("agg17_class_shares", ctes("labelled") + """
SELECT lang, route, count(*) AS n, round(count(*) / (SELECT count(*) FROM labelled)::DOUBLE, 6) AS share
FROM labelled GROUP BY ALL""")
def _(spark, root):
    shares = metrics.class_shares(feeds.labelled_documents(spark, root), "lang", "route")
    return shares.withColumn("share", r6(F.col("share")))
