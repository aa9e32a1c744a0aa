"""Registry of queries and, where SQL can state them, their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: Column) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


# Common table expressions of the feeds, for the SQL side.
CTES = {
    "queries": """
queries AS (
  SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'gsm8k' WHEN 'AUTOMOBILE' THEN 'math'
              WHEN 'MACHINERY' THEN 'mmlu' WHEN 'HOUSEHOLD' THEN 'arc_c' ELSE 'gsm_symbolic_main' END AS data_source,
         o_orderkey AS query_id,
         CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN chr(CAST(65 + o_orderkey % 5 AS INTEGER))
              ELSE CAST(o_orderkey % 4 AS VARCHAR) END AS ground_truth
  FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "rollouts": """
picked AS (
  SELECT l_orderkey AS query_id,
         CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
           CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
           strftime(l_shipdate, '%Y-%m-%d'), l_returnflag, l_linestatus)), 1, 15) AS BIGINT) AS resp_idx,
         CASE WHEN l_partkey % 7 < 4 THEN l_orderkey % 4 ELSE CAST(l_quantity AS BIGINT) % 4 END AS q,
         l_partkey % 5 AS f,
         CAST(CASE WHEN l_partkey % 7 < 4 THEN l_orderkey % 5 ELSE l_linenumber % 5 END AS INTEGER) AS n
  FROM lineitem),
rollouts AS (
  SELECT o.data_source, o.query_id, l.resp_idx, o.ground_truth,
    CASE WHEN o.data_source IN ('mmlu', 'arc_c') THEN
      CASE f WHEN 0 THEN 'Reason. #### ' || chr(65 + n) WHEN 1 THEN 'The correct answer is: ' || chr(65 + n) || '.'
             WHEN 2 THEN 'I pick ' || chr(65 + n) WHEN 3 THEN '#### ' || chr(97 + n) ELSE 'not sure' END
    ELSE
      CASE f WHEN 0 THEN 'Step one. #### ' || q WHEN 1 THEN 'So ' || chr(92) || 'boxed{' || q || '}'
             WHEN 2 THEN '#### ' || q || ' dollars.' WHEN 3 THEN '#### ' || chr(92) || 'frac{' || 2 * q || '}{2}'
             ELSE 'I get ' || q END
    END AS response
  FROM picked l JOIN queries o ON l.query_id = o.query_id)""",
    "extra": """
extra AS (
  SELECT *, query_id // 100 AS batch_id, query_id % 1000 <> 7 AS is_train,
    CASE WHEN query_id % 3 = 0 THEN 'Question ' || query_id ELSE data_source || '_' || query_id END AS prompt_key
  FROM rollouts)""",
    "gt_ids": """
gt_ids AS (
  SELECT CASE data_source WHEN 'gsm_symbolic_main' THEN 'gsm_symbolic' ELSE data_source END AS dataset,
         query_id FROM queries WHERE query_id % 5 = 0)""",
    "query_vectors": """
query_vectors AS (
  SELECT data_source, query_id, embedding
  FROM queries JOIN embeddings ON vec_id = query_id % (SELECT count(*) FROM embeddings))""",
    "query_nodes": """
query_nodes AS (
  SELECT vec_id AS id, ['math', 'qa', 'code'][label % 3 + 1] AS domain, vec_id % 5 <> 0 AS is_memory,
         CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings)""",
    "rollout_nodes": """
rollout_nodes AS (
  SELECT vec_id // 8 AS query_id, vec_id % 8 AS resp_idx, vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding,
         label, CASE WHEN label % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward FROM embeddings)""",
    "labelled": """
labelled AS (
  SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic,
         CASE WHEN l.quality IS NULL THEN 'graph' ELSE 'gt' END AS route
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "log_lines": """
log_lines AS (
  SELECT event_id, 'step:' || event_id % 40 || ' - val-core/' || event_type || '/acc/mean@1:' ||
         CAST(floor(value) AS INTEGER) % 100 || ' - val-core/gsm8k/reward/mean@1:0.' || (10 + user_id % 90) AS line
  FROM events)""",
    "scored": """
scored AS (
  SELECT event_type AS dataset, user_id AS query_id, event_id AS resp_idx, floor(value) / 500.0::DOUBLE AS prob,
         CASE WHEN (event_id * 7 + CAST(floor(value) AS BIGINT)) % 5 < 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
  FROM events)""",
    "epoch_history": """
epoch_history AS (
  SELECT user_id % 20 AS run, event_id % 25 + 1 AS epoch, round(avg(floor(value) / 500.0::DOUBLE), 6) AS metric
  FROM events GROUP BY ALL)""",
    "chats": """
chats AS (
  SELECT conv_id, min_by(text, turn) FILTER (role = 'system') AS system_text,
         min_by(text, turn) FILTER (role = 'user') AS first_user,
         max_by(text, turn) FILTER (role = 'user') AS last_user,
         count(*) FILTER (role = 'user') AS users
  FROM conversations GROUP BY conv_id)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",".join(CTES[n] for n in names)


ROLLOUTS = ctes("queries", "rollouts")
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
