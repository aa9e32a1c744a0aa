"""Registered queries: streams drained over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.plans import mixed_reward as mixed
from rewardloom.plans.queries_reward import IS_QA, MIXED_SQL, duck_math_correct
from rewardloom.plans.queries_text import duck_boxed, duck_hash_answer, duck_letter
from rewardloom.plans.registry import ROLLOUTS, query, r6
from rewardloom.session import store
from rewardloom.sources import feeds
from rewardloom.streaming import outcomes, scoring as streams


PARTS = 4  # micro-batches that the rollout files come in


def rollout_stream(spark, root):
    return feeds.shape_rollouts(feeds.stream_of(spark, root, "lineitem.parquet"), feeds.queries(spark, root))


def event_stream(spark, root):
    return feeds.shape_events(feeds.stream_of(spark, root, "events.parquet"))


@query("stm1_stream_scoring", ROLLOUTS + f""",
pred AS (SELECT *, coalesce({duck_hash_answer('response')}, {duck_boxed('response')}) AS m, {duck_letter('response', 'E', 'D', 'NULL')} AS l FROM rollouts)
SELECT query_id, resp_idx, CASE WHEN {IS_QA} THEN CASE WHEN l = ground_truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN m IS NOT NULL AND {duck_math_correct('m', 'ground_truth')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM pred""")
def _(spark, root):
    scored = streams.score_stream(rollout_stream(spark, root)).select("query_id", "resp_idx", "reward")
    return streams.append_to_table(scored, "scored")


@query("stm2_route_counters", """
SELECT CASE WHEN user_id % 5 = 0 THEN 'gt' ELSE 'graph' END AS reward_source, count(*) AS n FROM events GROUP BY 1""")
def _(spark, root):
    counters = streams.route_counters(event_stream(spark, root), F.col("query_id") % 5 == 0)
    return streams.latest_state(counters, "counters", ["reward_source"])


@query("stm3_stream_mixed_reward", MIXED_SQL + """
SELECT data_source, reward_source, count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg(prob), 6) AS mean_prob FROM mixed GROUP BY ALL""")
def _(spark, root):
    rows, ids, vectors = feeds.rollouts_with_extra(spark, root), feeds.gt_ids(spark, root), feeds.query_vectors(spark, root)
    folder = streams.new_folder(rows, "rollout-files")
    # A batch arrives in one file, the stream in four parts of as many files as there are cores.
    rows = store(rows.repartition(PARTS * spark.sparkContext.defaultParallelism, "batch_id"), folder)
    stream = feeds.stream_of(spark, folder, files_per_batch=max(1, -(-len(rows.inputFiles()) // PARTS)))
    keyed = mixed.keyed_vectors(vectors).stored()
    rewards = streams.mixed_stream(stream, ids, keyed, mixed.graph_memory(rows, ids, keyed))
    return rewards.groupBy("data_source", "reward_source").agg(
        F.count("*").alias("n"), r6(F.avg("reward")).alias("mean_reward"), r6(F.avg(r6(F.col("prob")))).alias("mean_prob"))


@query("stm4_redelivered_once", """
SELECT event_type AS source, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS checksum FROM events GROUP BY 1""")
def _(spark, root):
    once = event_stream(spark, root)
    twice = once.unionByName(event_stream(spark, root))
    kept = streams.append_to_table(streams.drop_redelivered(twice, ["query_id", "resp_idx"], "40 days"), "once")
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.sum("resp_idx").alias("checksum"))


@query("stm5_reward_rate", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS source, count(*) AS n,
  round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM events GROUP BY ALL""")
def _(spark, root):
    rates = streams.latest_state(streams.reward_rate(event_stream(spark, root)), "rate", ["window_start", "source"])
    return rates.withColumn("rate", r6(F.col("rate"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_OUTCOMES = """
SELECT event_id AS resp_idx, user_id AS query_id, CAST(ts AS TIMESTAMP) AS ts,
  CAST(ts AS TIMESTAMP) + to_minutes(CAST(event_id % 20 - 3 AS BIGINT)) AS outcome_ts, value > 50 AS passed,
  event_id % 7 <> 0 AND event_id % 20 BETWEEN 3 AND 13 AS counts FROM events"""


@query("stm1_outcome_join", f"""
SELECT resp_idx, query_id, CASE WHEN counts AND passed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward, counts AS has_outcome FROM ({_OUTCOMES})""")
def _(spark, root):
    """Events as rollouts, and a second stream of their outcomes: some early, some past the timeout, a seventh missing.

    Each stream comes in several files and ends with a far heartbeat, which lets the
    watermark pass every timeout.
    """
    rows = feeds.shape_events(feeds.table(spark, root, "events")).select("resp_idx", "query_id", "ts", "reward")
    minutes = F.make_interval(mins=(F.col("resp_idx") % 20 - 3).cast("int"))
    tests = rows.where("resp_idx % 7 <> 0").select(
        "resp_idx", "query_id", (F.col("ts") + minutes).alias("ts"), (F.col("reward") == 1).alias("passed"))
    joined = outcomes.outcome_rewards(
        _in_files(rows.drop("reward"), -1), _in_files(tests, -2), ["resp_idx", "query_id"], delay="40 days")
    drained = streams.append_to_table(joined, "outcomes").where("resp_idx >= 0")
    return drained.select("resp_idx", "query_id", "reward", F.col("outcome_ts").isNotNull().alias("has_outcome"))


def _in_files(rows, last_id):
    """A stream over files of the rows, closed by one row 90 days after them."""
    folder = streams.new_folder(rows, "stream-files")
    rows.repartition(3, "resp_idx").write.parquet(folder)
    beat = rows.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).select(
        *[F.lit(last_id).cast(t).alias(c) if c in ("resp_idx", "query_id") else F.col(c) if c == "ts" else F.lit(None).cast(t).alias(c)
          for c, t in rows.dtypes])
    beat.write.mode("append").parquet(folder)
    return feeds.stream_of(rows.sparkSession, folder, files_per_batch=3)
