"""Registered queries: sources, sinks and ingest projections over whole tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import prompts
from rewardloom.functions.text import split_scored
from rewardloom.operators import ingest
from rewardloom.operators.routing import entry
from rewardloom.plans.registry import ROLLOUTS, ctes, query, r6
from rewardloom.schema import EXTRA_INFO, QUERY
from rewardloom.session import shared_folder
from rewardloom.sources import feeds, readers, writers

NL = "chr(10)"


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def duck_fill(template: str, **values: str) -> str:
    """The SQL concatenation of a prompt template."""
    parts = re.split(r"\{(\w+)\}", template)
    out = [literal(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts)]
    return "(" + " || ".join(out) + ")"


def _flat_columns(*attrs: str) -> list[Column]:
    return [
        F.col("extra_info.index").alias("idx"), F.col("data_source"), F.col("ability"),
        F.get("prompt", 1)["content"].alias("user_text"), F.get("prompt", 0)["role"].alias("first_role"),
        F.col("reward_model.ground_truth").alias("ground_truth"), F.col("extra_info.answer").alias("answer"),
        *[entry(F.col("extra_info.attrs"), a).alias(a) for a in attrs],
    ]


def flat(df: DataFrame, *attrs: str) -> DataFrame:
    """Canonical rows with their nested parts as plain columns."""
    return df.select(*_flat_columns(*attrs))


def docs(spark, root) -> DataFrame:
    return feeds.spread(feeds.table(spark, root, "documents"))


def parts(spark, root) -> DataFrame:
    return feeds.table(spark, root, "part")


def lit_text(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])


@query("src1_read_splits", """
SELECT 'customer' AS dataset, 'train' AS split, c_custkey AS key, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', 'valid', s_suppkey, s_acctbal, NULL FROM supplier""")
def _(spark, root):
    merged = readers.read_splits(spark, {
        ("customer", "train"): f"{root}/customer.parquet",
        ("supplier", "valid"): f"{root}/supplier.parquet",
        ("absent", "test"): f"{root}/no_such_file.parquet",
    })
    return merged.select(
        "dataset", "split", F.coalesce("c_custkey", "s_suppkey").alias("key"),
        F.coalesce("c_acctbal", "s_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))


@query("src2_rollout_lists", """
SELECT p_partkey AS query_id, CAST(p_size AS VARCHAR) AS domain, CAST(unnest([0, 1]) AS BIGINT) AS resp_idx,
  unnest([p_name, p_brand]) AS response FROM part""")
def _(spark, root):
    record = F.to_json(F.struct(
        F.col("p_partkey").alias("query_idx"), F.col("p_size").cast("string").alias("domain"),
        F.array("p_name", "p_brand").alias("responses")))
    folder = new_folder(spark, "rollout-lines")
    parts(spark, root).select(record.alias("value")).write.text(folder)
    return readers.read_rollouts(spark, folder).drop("extra_info")


@query("src3_first_node_table", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def _(spark, root):
    found = readers.read_first(spark, [f"{root}/nodes_train.parquet", f"{root}/embeddings.parquet"])
    return found.select("vec_id", "label", F.size("embedding").alias("dim"))


@query("src4_gt_identifiers", """
SELECT DISTINCT dataset, identifier, domain FROM (
  SELECT 'gsm8k' AS dataset, CAST(p_partkey AS VARCHAR) AS identifier, 'math' AS domain FROM part
  UNION ALL SELECT 'gsm8k', 'x' || p_size, 'math' FROM part
  UNION ALL SELECT 'mmlu', CAST(p_size AS VARCHAR), 'qa' FROM part)""")
def _(spark, root):
    body = lit_text('{"GSM8K": {"indices": ["', F.col("p_partkey"), '.0", "x', F.col("p_size"),
                    '"], "n_total": 2}, "mmlu": [', F.col("p_size"), '], "elsewhere": [1], "math": "bad"}')
    folder = new_folder(spark, "gt-ids")
    parts(spark, root).select(body.alias("value")).write.text(folder)
    return readers.read_gt_ids(spark, folder)


@query("src5_log_lines", ctes("log_lines") + """
SELECT regexp_extract(line, 'step:(\\d+)', 1) AS step, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
FROM log_lines GROUP BY 1""")
def _(spark, root):
    folder = new_folder(spark, "logs")
    feeds.log_lines(spark, root).select(F.col("line").alias("value")).write.text(folder)
    lines = readers.read_logs(spark, folder)
    return lines.groupBy(F.regexp_extract("line", r"step:(\d+)", 1).alias("step")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_SETS = "['gsm8k', 'numina_math', 'piqa', 'mmlu', 'tdc_admet', 'siqa', 'math', 'dti_bind'][CAST(doc_id % 8 AS INTEGER) + 1]"


@query("src6_test_sets", f"""
WITH t AS (SELECT {_SETS} AS dataset FROM documents)
SELECT CASE WHEN dataset IN ('numina_math', 'piqa', 'siqa') THEN 'generalization' ELSE 'standard' END AS kind, dataset,
  count(*) AS n FROM t WHERE dataset NOT IN ('tdc_admet', 'dti_bind') GROUP BY ALL""")
def _(spark, root):
    names = ["gsm8k", "numina_math", "piqa", "mmlu", "tdc_admet", "siqa", "math", "dti_bind"]
    tagged = feeds.table(spark, root, "documents").select(
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 8 + 1).cast("int")).alias("dataset"))
    folder = new_folder(spark, "test-sets")
    for name in names:
        tagged.where(F.col("dataset") == name).withColumn("row", F.lit(1)).drop("dataset").write.parquet(
            f"{folder}/{name}_sampled_test.parquet")
    kinds = [readers.read_test_sets(spark, folder, kind).withColumn("kind", F.lit(kind))
             for kind in ("generalization", "standard")]
    return kinds[0].unionByName(kinds[1]).groupBy("kind", "dataset").agg(F.count("*").alias("n"))


@query("snk1_typed_reward_model", ctes("queries") + "SELECT query_id, data_source, ground_truth FROM queries")
def _(spark, root):
    typed = feeds.queries(spark, root).select(
        "data_source", F.lit(None).cast(QUERY["prompt"].dataType).alias("prompt"), F.lit("math").alias("ability"),
        writers.typed_reward_model(F.col("ground_truth")).alias("reward_model"),
        F.from_json(F.to_json(F.struct(F.col("query_id").alias("index"))), EXTRA_INFO).alias("extra_info"),
        F.col("data_source").alias("dataset"), F.when(F.col("query_id") % 10 == 0, "test").otherwise("train").alias("split"))
    folder = new_folder(spark, "queries")
    writers.write_queries(typed, folder)
    return readers.read_queries(spark, folder).select(
        F.col("extra_info.index").alias("query_id"), "data_source", "reward_model.ground_truth")


@query("snk2_summary_lines", ctes("scored") + """
SELECT format('{:<20}: {}/{} = {:.2f}%', dataset, c, n, round(100.0::DOUBLE * c / n, 2)) AS value
FROM (SELECT dataset, count(*) FILTER (reward > 0.5) AS c, count(*) AS n FROM scored GROUP BY dataset)""")
def _(spark, root):
    counts = feeds.scored(spark, root).groupBy("dataset").agg(
        F.count_if(F.col("reward") > 0.5).alias("correct"), F.count("*").alias("total"))
    return writers.summary_lines(
        counts.withColumn("accuracy", F.round(100 * F.col("correct") / F.col("total"), 2)))


@query("snk2_evaluation_files", ctes("scored") + """,
s AS (SELECT dataset, count(*) FILTER (reward > 0.5) AS correct, count(*) AS total FROM scored GROUP BY dataset)
SELECT 'details' AS file, dataset, total AS n, CAST(correct AS BIGINT) AS correct FROM s
UNION ALL SELECT 'correct', dataset, correct, correct FROM s WHERE correct > 0
UNION ALL SELECT 'summary', dataset, total, correct FROM s""")
def _(spark, root):
    details = feeds.scored(spark, root).withColumn("correct", F.col("reward") > 0.5)
    summary = details.groupBy("dataset").agg(F.count_if("correct").alias("correct"), F.count("*").alias("total")).withColumn(
        "accuracy", F.round(100 * F.col("correct") / F.col("total"), 2))
    folder = new_folder(spark, "evaluation")
    writers.write_evaluation(details, summary, folder)
    fields = "dataset string, query_id bigint, resp_idx bigint, prob double, reward double, correct boolean"
    parts = [
        spark.read.schema(fields).json(f"{folder}/{name}").groupBy(F.lit(name).alias("file"), "dataset").agg(
            F.count("*").alias("n"), F.count_if("correct").alias("correct")) for name in ("details", "correct")]
    totals = spark.read.schema("dataset string, correct bigint, total bigint").json(f"{folder}/summary").select(
        F.lit("summary").alias("file"), "dataset", F.col("total").alias("n"), "correct")
    return parts[0].unionByName(parts[1]).unionByName(totals)


@query("snk3_node_table", ctes("query_nodes") + """
SELECT id AS query_id, domain, is_memory, CAST(len(embedding) AS INTEGER) AS dim FROM query_nodes""")
def _(spark, root):
    nodes = feeds.query_nodes(spark, root).select(
        F.lit("query").alias("node_type"), "query_id", F.lit(None).cast("bigint").alias("resp_idx"), "domain", "is_memory",
        F.col("embedding").cast("array<float>").alias("embedding"), F.lit(None).cast("array<double>").alias("answer_features"))
    path = new_folder(spark, "nodes")
    writers.write_nodes(nodes, path)
    return readers.read_nodes(spark, [f"{path}_train", path]).select(
        "query_id", "domain", "is_memory", F.size("embedding").alias("dim"))


@query("ing1_gsm8k", f"""
SELECT doc_id AS idx, 'gsm8k' AS data_source, 'math' AS ability, {duck_fill(prompts.TEMPLATES['gsm8k'], question='text')} AS user_text,
  'system' AS first_role, a AS ground_truth, a AS answer, f AS full_answer
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'Step. #### ' || n_chars || ' ' WHEN 1 THEN 'a #### b #### ' || doc_id ELSE lang END AS f,
  CASE doc_id % 3 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE lang END AS a FROM documents)""")
def _(spark, root):
    shape = F.col("doc_id") % 3
    answer = (
        F.when(shape == 0, lit_text("Step. #### ", F.col("n_chars"), " "))
        .when(shape == 1, lit_text("a #### b #### ", F.col("doc_id"))).otherwise(F.col("lang"))
    )
    raw = docs(spark, root).select(F.col("doc_id").alias("index"), F.col("text").alias("question"), answer.alias("answer"))
    return flat(ingest.gsm8k(raw), "full_answer")


@query("ing2_gsm_symbolic", f"""
SELECT p_partkey AS idx, 'gsm_symbolic_p1' AS data_source, 'math' AS ability,
  {duck_fill(prompts.TEMPLATES['gsm8k'], question='p_name')} AS user_text, 'system' AS first_role,
  CAST(p_size AS VARCHAR) AS ground_truth, CAST(p_size AS VARCHAR) AS answer,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey ELSE p_partkey % 50 END AS VARCHAR) AS template_id,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS VARCHAR) AS instance_id FROM part""")
def _(spark, root):
    key = F.col("p_partkey")
    raw = parts(spark, root).select(
        key.alias("index"), F.col("p_name").alias("question"), lit_text("so #### ", F.col("p_size")).alias("answer"),
        F.when(key % 4 != 0, key % 50).alias("template_id"), F.when(key % 3 != 0, F.col("p_size")).alias("instance_id"))
    return flat(ingest.gsm_symbolic(raw, "p1"), "template_id", "instance_id")


@query("ing3_humaneval", f"""
WITH p AS (SELECT *, 'f' || p_partkey AS ep, 'def f' || p_partkey || '(x):' || {NL} ||
    CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '    ""\" ' || p_name || {NL} || ' more ""\"' || {NL} END AS code FROM part),
q AS (SELECT *, 'assert ' || ep || '(1) == ' || p_size || {NL} || 'assert ' || ep || '(2) > 0' AS tests,
  CASE WHEN p_partkey % 3 = 0 THEN 'Complete the function ' || ep ELSE p_name || {NL} || ' more' END
    || {NL} || {NL} || 'Function signature:' || {NL} || code AS task FROM p)
SELECT p_partkey AS idx, 'humaneval_plus' AS data_source, 'coding' AS ability,
  {duck_fill(prompts.TEMPLATES['code'], question='task', tests=f"{literal(prompts.TESTS_HEADER)} || tests || {NL}")} AS user_text,
  'system' AS first_role, code || '    return ' || p_size AS ground_truth, code || '    return ' || p_size AS answer,
  'HumanEval/' || p_partkey AS task_id, ep AS entry_point, tests FROM q""")
def _(spark, root):
    key, name = F.col("p_partkey"), F.col("p_name")
    doc = F.when(key % 3 == 0, "").otherwise(lit_text('    """ ', name, '\n more """\n'))
    raw = parts(spark, root).select(
        key.alias("index"), lit_text("HumanEval/", key).alias("task_id"), lit_text("f", key).alias("entry_point"),
        lit_text("def f", key, "(x):\n", doc).alias("prompt"), lit_text("    return ", F.col("p_size")).alias("canonical_solution"),
        lit_text("def check(candidate):\n    assert candidate(1) == ", F.col("p_size"), "\n    assert candidate(2) > 0\n").alias("test"))
    made = ingest.humaneval(raw)
    tests = F.array_join("extra_info.test_list", "\n")
    return made.withColumn("tests", tests).select(*_flat_columns("task_id", "entry_point"), "tests")


@query("ing4_mbpp", f"""
WITH p AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE '' END AS task,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS sol,
  list_transform(range(0, p_partkey % 5), lambda i: 'assert g(' || i || ')') AS tests FROM part)
SELECT p_partkey AS idx, 'mbpp_plus' AS data_source, 'coding' AS ability,
  {duck_fill(prompts.TEMPLATES['code'], question='task', tests=f"CASE WHEN len(tests) > 0 THEN {literal(prompts.TESTS_HEADER)} || array_to_string(tests[1:3], {NL}) || {NL} ELSE '' END")} AS user_text,
  'system' AS first_role, sol AS ground_truth, sol AS answer FROM p""")
def _(spark, root):
    key = F.col("p_partkey")
    count = (key % 5).cast("int")
    tests = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: lit_text("assert g(", i, ")")))
    raw = parts(spark, root).select(
        key.alias("index"), F.when(key % 3 == 0, F.col("p_name")).alias("text"),
        F.when(key % 3 == 1, F.col("p_brand")).alias("prompt"), F.when(key % 2 == 0, F.col("p_type")).alias("code"),
        F.when(key % 2 == 1, F.col("p_brand")).alias("canonical_solution"), tests.alias("test_list"))
    return flat(ingest.mbpp(raw))


_CHOICES = f"'A. ' || p_name || {NL} || 'B. ' || p_brand || {NL} || 'C. ' || p_type || {NL} || 'D. ' || p_size"


@query("ing5_multiple_choice", f"""
WITH p AS (SELECT *, {_CHOICES} AS listed, chr(CAST(65 + p_partkey % 4 AS INTEGER)) AS a,
  ['obqa', 'arc_c', 'commonsenseqa'][CAST(p_partkey % 3 AS INTEGER) + 1] AS src FROM part)
SELECT p_partkey AS idx, src AS data_source, 'qa' AS ability, {duck_fill(prompts.TEMPLATES['mcq'], question='p_name', choices='listed')} AS user_text,
  'system' AS first_role, a AS ground_truth, a AS answer, listed AS choices FROM p""")
def _(spark, root):
    key = F.col("p_partkey")
    raw = parts(spark, root).select(
        key.alias("index"), F.col("p_name").alias("question"), F.array(*[F.lit(c) for c in "ABCD"]).alias("labels"),
        F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("choices"),
        feeds.letter(65, (key % 4).cast("int")).alias("answer"))
    sources = ["obqa", "arc_c", "commonsenseqa"]
    made = [ingest.multiple_choice(raw.where(F.col("index") % 3 == i), s) for i, s in enumerate(sources)]
    return flat(made[0].unionByName(made[1]).unionByName(made[2]), "choices")


@query("ing6_mmlu", f"""
WITH p AS (SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_size < 10),
q AS (SELECT *, {_CHOICES} AS listed, chr(CAST(65 + p_partkey % 4 AS INTEGER)) AS a FROM p)
SELECT p_partkey AS idx, 'mmlu' AS data_source, 'qa' AS ability, {duck_fill(prompts.TEMPLATES['mcq'], question='p_name', choices='listed')} AS user_text,
  'system' AS first_role, a AS ground_truth, a AS answer, p_type AS subject FROM q""")
def _(spark, root):
    raw = parts(spark, root).select(
        F.col("p_partkey").alias("index"), F.col("p_name").alias("question"), "p_size",
        F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")).alias("choices"),
        (F.col("p_partkey") % 4).cast("int").alias("answer"), F.col("p_type").alias("subject"))
    twice = raw.unionByName(raw.where(F.col("p_size") < 10))
    return flat(ingest.mmlu(twice), "subject")


_GPQA = """
WITH p AS (SELECT *, [p_name, p_brand, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END, 'x' || p_size] AS answers FROM part),
k AS (SELECT *, list_filter(answers, lambda a: a <> '') AS kept FROM p),
s AS (SELECT *, list_transform(list_sort(list_transform(range(0, len(kept)), lambda i: {'k': md5('42|' || p_partkey || '|' || i), 'a': kept[i + 1]})), lambda e: e.a) AS ord FROM k)
"""


@query("ing7_gpqa_shuffled", _GPQA + f"""
SELECT p_partkey AS idx, 'gpqa' AS data_source, 'qa' AS ability,
  {duck_fill(prompts.TEMPLATES['mcq'], question='p_name', choices=f"array_to_string(list_transform(range(0, len(ord)), lambda i: chr(CAST(65 + i AS INTEGER)) || '. ' || ord[i + 1]), {NL})")} AS user_text,
  'system' AS first_role, chr(CAST(64 + list_position(ord, p_name) AS INTEGER)) AS ground_truth,
  chr(CAST(64 + list_position(ord, p_name) AS INTEGER)) AS answer FROM s""")
def _(spark, root):
    return flat(ingest.gpqa(_gpqa_raw(spark, root)))


@query("ing7_gpqa_given_order", """
SELECT p_partkey AS idx, 'gpqa' AS data_source, CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE 'B' END AS ground_truth FROM part""")
def _(spark, root):
    raw = _gpqa_raw(spark, root).withColumn(
        "correct", F.when(F.col("index") % 5 == 0, "nothing like it").otherwise(F.get("answers", 1)))
    return flat(ingest.gpqa(raw, shuffle=False)).select("idx", "data_source", "ground_truth")


def _gpqa_raw(spark, root) -> DataFrame:
    key = F.col("p_partkey")
    answers = F.array("p_name", "p_brand", F.when(key % 6 == 0, "").otherwise(F.col("p_type")), lit_text("x", F.col("p_size")))
    return parts(spark, root).select(
        key.alias("index"), F.col("p_name").alias("question"), answers.alias("answers"), F.col("p_name").alias("correct"))


@query("ing8_competition_math", f"""
WITH d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text
    ELSE text || ' so ' || chr(92) || 'boxed{{0}} or ' || chr(92) || 'boxed{{' || chr(92) || 'frac{{' || doc_id || '}}{{2}}}}.' END AS s,
  CASE WHEN doc_id % 3 = 0 THEN text ELSE chr(92) || 'frac{{' || doc_id || '}}{{2}}' END AS a FROM documents)
SELECT doc_id AS idx, 'math' AS data_source, 'math' AS ability, {duck_fill(prompts.TEMPLATES['math_competition'], question='source')} AS user_text,
  'system' AS first_role, 'math_reward' AS ground_truth, a AS answer, lang AS level, s AS solution FROM d""")
def _(spark, root):
    solution = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        lit_text(F.col("text"), " so \\boxed{0} or \\boxed{\\frac{", F.col("doc_id"), "}{2}}."))
    raw = docs(spark, root).select(
        F.col("doc_id").alias("index"), F.col("source").alias("problem"), solution.alias("solution"),
        F.col("lang").alias("level"), F.col("source").alias("type"))
    return flat(ingest.competition_math(raw), "level", "solution")


@query("ing9_numina", f"""
WITH d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN text || ' ' || chr(92) || 'boxed{{' || chr(92) || 'frac{{' || doc_id || '}}{{2}}}} #### 3'
    WHEN 1 THEN text || ' #### 1 #### ' || doc_id || ' ' ELSE text || {NL} || 'last ' || doc_id || '  ' END AS s,
  CASE doc_id % 3 WHEN 0 THEN chr(92) || 'frac{{' || doc_id WHEN 1 THEN CAST(doc_id AS VARCHAR) ELSE 'last ' || doc_id END AS a FROM documents)
SELECT doc_id AS idx, 'numina_math' AS data_source, 'math' AS ability, {duck_fill(prompts.TEMPLATES['math_competition'], question='source')} AS user_text,
  'system' AS first_role, a AS ground_truth, a AS answer FROM d""")
def _(spark, root):
    shape, key, body = F.col("doc_id") % 3, F.col("doc_id"), F.col("text")
    solution = (
        F.when(shape == 0, lit_text(body, " \\boxed{\\frac{", key, "}{2}} #### 3"))
        .when(shape == 1, lit_text(body, " #### 1 #### ", key, " ")).otherwise(lit_text(body, "\nlast ", key, "  "))
    )
    raw = docs(spark, root).select(key.alias("index"), F.col("source").alias("problem"), solution.alias("solution"))
    return flat(ingest.numina(raw))


@query("ing10_context_choices", f"""
WITH p AS (SELECT *, 'A. ' || p_name || {NL} || 'B. ' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE {NL} || 'C. ' || p_type END AS c3,
  'A. ' || p_name || {NL} || 'B. ' || p_brand AS c2 FROM part)
SELECT p_partkey AS idx, 'siqa' AS data_source, {duck_fill(prompts.TEMPLATES['mcqa'], question='p_name', context='p_type', choices='c3')} AS user_text,
  chr(CAST(65 + p_partkey % 3 AS INTEGER)) AS ground_truth FROM p
UNION ALL SELECT p_partkey, 'piqa', {duck_fill(prompts.TEMPLATES['mcqa'], question='p_name', context='p_type', choices='c2')},
  chr(CAST(65 + p_partkey % 2 AS INTEGER)) FROM p""")
def _(spark, root):
    key = F.col("p_partkey")
    base = parts(spark, root).select(key.alias("index"), F.col("p_name").alias("question"), F.col("p_type").alias("context"), "*")
    three = base.select("index", "question", "context", F.array(
        "p_name", "p_brand", F.when(key % 4 == 0, "").otherwise(F.col("p_type"))).alias("choices"), (key % 3 + 1).cast("int").alias("label"))
    two = base.select("index", "question", "context", F.array("p_name", "p_brand").alias("choices"), (key % 2).cast("int").alias("label"))
    both = ingest.context_choices(three, "siqa", 1).unionByName(ingest.context_choices(two, "piqa", 0))
    return flat(both).select("idx", "data_source", "user_text", "ground_truth")


@query("ing11_prompt_templates", " UNION ALL ".join(
    f"SELECT p_partkey, '{kind}' AS kind, {sql} AS user_text, {literal(prompts.CODE_SYSTEM if kind == 'code' else prompts.SYSTEM)} AS system_text FROM part"
    for kind, sql in {
        "gsm8k": duck_fill(prompts.TEMPLATES["gsm8k"], question="p_name"),
        "code": duck_fill(prompts.TEMPLATES["code"], question="p_name",
                          tests=f"{literal(prompts.TESTS_HEADER)} || p_brand || {NL} || p_type || {NL}"),
        "mcq": duck_fill(prompts.TEMPLATES["mcq"], question="p_name", choices="p_type"),
        "open_qa": f"CASE WHEN p_partkey % 2 = 0 THEN {duck_fill(prompts.TEMPLATES['passage_qa'], question='p_name', context='p_type')} "
                   f"ELSE {duck_fill(prompts.TEMPLATES['open_qa'], question='p_name')} END",
        "math": duck_fill(prompts.TEMPLATES["math"], question="p_name"),
        "math_competition": duck_fill(prompts.TEMPLATES["math_competition"], question="p_name"),
        "mcqa": duck_fill(prompts.TEMPLATES["mcqa"], question="p_name", context="p_brand", choices="p_type"),
    }.items()))
def _(spark, root):
    q, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    context = F.when(F.col("p_partkey") % 2 == 0, kind)
    made = {
        "gsm8k": prompts.templated("gsm8k", q),
        "code": prompts.templated("code", q, tests=F.array(brand, kind)),
        "mcq": prompts.templated("mcq", q, choices=kind),
        "open_qa": prompts.open_question(q, context),
        "math": prompts.templated("math", q),
        "math_competition": prompts.templated("math_competition", q),
        "mcqa": prompts.templated("mcqa", q, context=brand, choices=kind),
    }
    pairs = F.array(*[F.struct(F.lit(name).alias("kind"), value.alias("m")) for name, value in made.items()])
    return parts(spark, root).select("p_partkey", F.explode(pairs).alias("e")).select(
        "p_partkey", "e.kind", F.get("e.m", 1)["content"].alias("user_text"), F.get("e.m", 0)["content"].alias("system_text"))


@query("ing12_resolved_prompt", ctes("chats") + f"""
SELECT conv_id, CASE WHEN system_text IS NULL AND first_user IS NULL THEN {literal(prompts.DOMAIN_SYSTEM['math'])}
    WHEN system_text IS NULL THEN first_user ELSE system_text END AS first_text,
  CASE WHEN system_text IS NULL AND first_user IS NULL THEN 'Conversation ' || conv_id
    WHEN users > 1 THEN last_user WHEN first_user IS NOT NULL THEN first_user ELSE system_text END AS last_text FROM chats""")
def _(spark, root):
    question = lit_text("Conversation ", F.col("conv_id"))
    prompt = prompts.parsed_prompt(F.to_json("prompt"))
    rows = feeds.chats(spark, root).withColumn("p", prompts.resolved_prompt(prompt, question, F.lit("math")))
    return rows.select("conv_id", F.get("p", 0)["content"].alias("first_text"), prompts.query_text(F.col("p")).alias("last_text"))


@query("ing13_resolved_extra", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') END AS k,
  CASE event_id % 3 WHEN 1 THEN event_type WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'key' ELSE event_type END END AS answer FROM events""")
def _(spark, root):
    shape = F.col("event_id") % 3
    extra = F.when(shape == 0, F.col("props"))
    key = F.when((shape == 2) & (F.col("event_id") % 2 == 0), "key")
    rows = feeds.table(spark, root, "events").select(
        "event_id", ingest.resolved_extra(extra, F.col("event_type"), key).alias("x"))
    return rows.select("event_id", entry(F.col("x"), "k").alias("k"), entry(F.col("x"), "answer").alias("answer"))


@query("ing14_query_text", ctes("chats") + """
SELECT conv_id, CASE WHEN users > 1 THEN last_user WHEN first_user IS NOT NULL THEN first_user ELSE system_text END AS query_text,
  coalesce(first_user, '') AS question FROM chats""")
def _(spark, root):
    return feeds.chats(spark, root).select(
        "conv_id", prompts.query_text(F.col("prompt")).alias("query_text"),
        prompts.first_question(F.col("prompt")).alias("question"))


@query("ing15_reward_model", ROLLOUTS + """
SELECT query_id, resp_idx,
  CASE resp_idx % 6 WHEN 0 THEN response WHEN 1 THEN ground_truth WHEN 2 THEN 'text ' || query_id WHEN 3 THEN ''
    WHEN 4 THEN ground_truth ELSE CAST(query_id + 1 AS VARCHAR) END AS normalised,
  CASE resp_idx % 6 WHEN 0 THEN response WHEN 1 THEN ground_truth WHEN 2 THEN '' WHEN 3 THEN ''
    WHEN 4 THEN '' ELSE CAST(query_id + 1 AS VARCHAR) END AS repaired FROM rollouts""")
def _(spark, root):
    shape = F.col("resp_idx") % 6
    model = (
        F.when(shape == 0, F.to_json(F.struct(F.col("response").alias("ground_truth"))))
        .when(shape == 1, "math_reward").when(shape == 2, lit_text("text ", F.col("query_id")))
        .when(shape == 4, "Mathematics").when(shape == 5, (F.col("query_id") + 1).cast("string"))
    )
    rows = feeds.rollouts(spark, root).withColumns(
        {"rm": model, "extra": F.create_map(F.lit("answer"), F.col("ground_truth"))})
    return rows.select(
        "query_id", "resp_idx",
        ingest.normalised_reward_model(F.col("rm"), F.col("extra"))["ground_truth"].alias("normalised"),
        ingest.repaired_reward_model(F.col("rm"), F.col("extra"))["ground_truth"].alias("repaired"))


@query("ing16_flag_training", ctes("queries") + """
SELECT query_id, query_id % 10 <> 0 AS is_train, query_id % 10 <> 0 AS inner_flag FROM queries""")
def _(spark, root):
    rows = feeds.queries(spark, root).withColumn(
        "extra_info", F.struct(F.col("ground_truth").alias("answer"), F.lit(None).cast("boolean").alias("is_train")))
    return ingest.flag_training(rows, F.col("query_id") % 10 != 0).select(
        "query_id", "is_train", F.col("extra_info.is_train").alias("inner_flag"))


@query("ing17_encoder_inputs", """
SELECT doc_id, text AS query_text, text AS think_text, text AS answer_text
FROM documents""")
def _(spark, root):
    rows = docs(spark, root).withColumn("p", split_scored(F.col("text")))
    return rows.select("doc_id", *ingest.encoder_inputs(F.col("text"), F.col("p.think"), F.col("p.answer")))


_ING18_PLACES = """
WITH words AS (
  SELECT doc_id, CAST('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))), 1, 4) AS BIGINT) % 64 AS place FROM documents),
tf AS (SELECT doc_id, place, count(*) AS n FROM words GROUP BY ALL),
idf AS (SELECT place, ln((SELECT count(*) + 1 FROM documents) / (count(*) + 1.0::DOUBLE)) AS idf FROM tf GROUP BY place),
weighed AS (SELECT doc_id, place, n * idf AS x FROM tf JOIN idf USING (place))
"""


@query("ing18_encode_text", _ING18_PLACES + """
SELECT doc_id, CAST(place AS INTEGER) AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) + 0.0::DOUBLE AS weight
FROM weighed QUALIFY sum(x * x) OVER (PARTITION BY doc_id) > 0 AND x <> 0""")
def _(spark, root):
    """Every place of every document's vector, with document frequencies fitted over the whole table."""
    rows = ingest.encode_text(docs(spark, root).select("doc_id", "text"), "text", 64)
    return rows.select("doc_id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").select(
        "doc_id", "place", r6(F.col("x")).alias("weight"))
