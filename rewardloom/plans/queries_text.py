"""Registered queries: text, number and JSON expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import numeric, text
from rewardloom.functions.domains import cache_domain, gt_only_domain, memory_domain, scoring_domain
from rewardloom.functions.vectors import as_double, cosine, norm
from rewardloom.operators.routing import entry, parse_extra
from rewardloom.plans.registry import ROLLOUTS, SPACE, ctes, query, r6
from rewardloom.sources import feeds

KEYS = ["query_id", "resp_idx"]
BS = chr(92)

# Texts with every marker shape, built from rollouts, on both sides.
VARIED_SQL = ROLLOUTS + """,
varied AS (
  SELECT data_source, query_id, resp_idx, ground_truth, response,
    CASE resp_idx % 9
      WHEN 0 THEN response
      WHEN 1 THEN 'We get ' || chr(92) || 'boxed{1} then ' || chr(92) || 'boxed{' || chr(92) || 'frac{a' || query_id % 7 || '}{b{c}}} end.'
      WHEN 2 THEN 'open ' || chr(92) || 'boxed{x {y} ' || query_id % 5
      WHEN 3 THEN '####' || chr(10) || chr(10) || response || chr(10) || 'and more'
      WHEN 4 THEN '<think> plan ' || query_id % 3 || ' </think> ' || response
      WHEN 5 THEN '<think>only thoughts</think>  '
      WHEN 6 THEN 'Code:' || chr(10) || '```python' || chr(10) || 'def add(a, b):' || chr(10) || '    return a + ' || query_id % 9 || chr(10) || '```' || chr(10) || 'done'
      WHEN 7 THEN 'The total is $1,' || lpad(CAST(query_id % 1000 AS VARCHAR), 3, '0') || '.50 #### 1,' || lpad(CAST(query_id % 1000 AS VARCHAR), 3, '0') || '.50 dollars'
      ELSE 'x <answer> ' || query_id % 11 || ' </answer> #### ...'
    END AS txt
  FROM rollouts)
"""


def varied(spark, root) -> DataFrame:
    rows = feeds.rollouts(spark, root)
    r, q = F.col("response"), F.col("query_id")
    shape = F.col("resp_idx") % 9
    padded = F.lpad((q % 1000).cast("string"), 3, "0")

    def mod(n: int) -> Column:
        return (q % n).cast("string")

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    txt = (
        F.when(shape == 0, r)
        .when(shape == 1, say("We get \\boxed{1} then \\boxed{\\frac{a", mod(7), "}{b{c}}} end."))
        .when(shape == 2, say("open \\boxed{x {y} ", mod(5)))
        .when(shape == 3, say("####\n\n", r, "\nand more"))
        .when(shape == 4, say("<think> plan ", mod(3), " </think> ", r))
        .when(shape == 5, F.lit("<think>only thoughts</think>  "))
        .when(shape == 6, say("Code:\n```python\ndef add(a, b):\n    return a + ", mod(9), "\n```\ndone"))
        .when(shape == 7, say("The total is $1,", padded, ".50 #### 1,", padded, ".50 dollars"))
        .otherwise(say("x <answer> ", mod(11), " </answer> #### ..."))
    )
    return rows.withColumn("txt", txt)


def duck_strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


HASH = r"'####\s*([^#\n][^\n]*?)(?:\s*####|\s*$)'"
BOX1 = r"'\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}'"
BOX2 = r"'\\boxed\{(.+?)\}'"


def duck_hash_answer(x: str) -> str:
    """Marker answer: direct match, else the first usable later segment."""
    later = (
        f"list_filter(list_transform(string_split({x}, '####')[2:], lambda p: {duck_strip('split_part(' + duck_strip('p') + ', chr(10), 1)')}),"
        f" lambda p: p <> '' AND NOT starts_with(p, '#'))[1]"
    )
    return (
        f"CASE WHEN contains({x}, '####') THEN coalesce(nullif(rtrim({duck_strip(f'regexp_extract({x}, {HASH}, 1)')}, '.'), ''),"
        f" rtrim({later}, '.')) END"
    )


def duck_boxed(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {BOX1}) THEN {duck_strip(f'regexp_extract({x}, {BOX1}, 1)')}"
        f" WHEN regexp_matches({x}, {BOX2}) THEN {duck_strip(f'regexp_extract({x}, {BOX2}, 1)')} END"
    )


def duck_letter(x: str, top: str = "E", last: str = "D", default: str = "'X'") -> str:
    up = f"upper({x})"
    return (
        f"coalesce(nullif(regexp_extract({up}, '####\\s*([A-{top}])\\b', 1), ''),"
        f" nullif(regexp_extract({up}, '(?:THE\\s+)?(?:CORRECT\\s+)?ANSWER\\s+IS\\s*:?\\s*([A-{top}])\\b', 1), ''),"
        f" nullif(regexp_extract({duck_strip(up)}, '\\b([A-{last}])\\b\\s*$', 1), ''), {default})"
    )


def duck_clean(x: str) -> str:
    """Strict clean-up before a number is read."""
    y = f"regexp_replace({x}, '\\\\(?:text|mathrm|mathbf)\\{{([^}}]+)\\}}', '\\1', 'g')"
    y = f"regexp_replace({y}, '\\\\frac\\{{([^}}]+)\\}}\\{{([^}}]+)\\}}', '\\1/\\2', 'g')"
    y = duck_strip(f"replace(replace({y}, chr(92), ''), '$', '')")
    y = f"lower(replace(replace({y}, ',', ''), ' ', ''))"
    return f"regexp_replace({y}, '(dollars?|cents?|%|degrees?|°)$', '', 'g')"


def duck_clean_generalization(x: str) -> str:
    y = f"regexp_replace({x}, '\\\\(?:text|mathrm|mathbf)\\{{([^}}]+)\\}}', '\\1', 'g')"
    y = f"regexp_replace({y}, '\\\\frac\\{{([^}}]+)\\}}\\{{([^}}]+)\\}}', '\\1/\\2', 'g')"
    y = f"lower(replace(replace({y}, chr(92), ''), ' ', ''))"
    return f"regexp_replace({y}, '(?:dollars?|cents?|\\$|%|degrees?|°)', '', 'g')"


def duck_number(clean: str) -> str:
    """Number of a cleaned answer: one quotient, else the first number."""
    top = f"TRY_CAST(trim(split_part({clean}, '/', 1), '()') AS DOUBLE)"
    bottom = f"TRY_CAST(trim(split_part({clean}, '/', 2), '()') AS DOUBLE)"
    return (
        f"CASE WHEN len(string_split({clean}, '/')) = 2 AND {bottom} <> 0 AND {top} IS NOT NULL THEN {top} / {bottom}"
        f" ELSE TRY_CAST(nullif(regexp_extract({clean}, '-?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE) END"
    )


@query("str1_answer_after_marker", VARIED_SQL + f"SELECT query_id, resp_idx, {duck_hash_answer('txt')} AS answer FROM varied")
def _(spark, root):
    return varied(spark, root).select(*KEYS, text.answer_after_marker(F.col("txt")).alias("answer"))


@query("str2_boxed_answer", VARIED_SQL + f"SELECT query_id, resp_idx, {duck_boxed('txt')} AS answer FROM varied")
def _(spark, root):
    return varied(spark, root).select(*KEYS, text.boxed_answer(F.col("txt")).alias("answer"))


@query("str3_last_boxed", VARIED_SQL + """,
tails AS (SELECT query_id, resp_idx, txt, list_last(string_split(txt, chr(92) || 'boxed{')) AS tail FROM varied),
ends AS (SELECT *, list_position(list_transform(range(1, length(tail) + 1), lambda i:
   length(replace(tail[1:i], '}', '')) - length(replace(tail[1:i], '{', ''))), -1) AS close FROM tails)
SELECT query_id, resp_idx, CASE WHEN NOT contains(txt, chr(92) || 'boxed{') THEN txt
  WHEN coalesce(close, 0) = 0 THEN tail ELSE tail[1:close - 1] END AS answer FROM ends""")
def _(spark, root):
    return varied(spark, root).select(*KEYS, text.last_boxed(F.col("txt")).alias("answer"))


@query("str4_choice_letter", VARIED_SQL + f"SELECT query_id, resp_idx, {duck_letter('txt')} AS letter FROM varied")
def _(spark, root):
    return varied(spark, root).select(*KEYS, text.choice_letter(F.col("txt")).alias("letter"))


@query("str5_choice_letter_generalization",
       VARIED_SQL + f"SELECT query_id, resp_idx, {duck_letter('txt', 'C', 'B', 'NULL')} AS letter FROM varied")
def _(spark, root):
    return varied(spark, root).select(*KEYS, text.choice_letter(F.col("txt"), "C", "B", None).alias("letter"))


@query("str6_extract_answer", VARIED_SQL + f"""
SELECT query_id, resp_idx, CASE WHEN data_source IN ('gsm8k', 'math', 'gsm_symbolic_main')
  THEN coalesce({duck_hash_answer('txt')}, {duck_boxed('txt')}) ELSE {duck_letter('txt', 'E', 'D', 'NULL')} END AS answer
FROM varied""")
def _(spark, root):
    return varied(spark, root).select(
        *KEYS, text.extract_answer(F.col("txt"), F.col("data_source")).alias("answer"))


@query("str7_code_answer", VARIED_SQL + f"""
SELECT query_id, resp_idx, {duck_strip("CASE WHEN contains(txt, '```python') THEN regexp_extract(txt, '(?s)```python\\s*(.*?)\\s*```', 1) ELSE txt END")} AS code
FROM varied""")
def _(spark, root):
    return varied(spark, root).select(*KEYS, text.code_answer(F.col("txt")).alias("code"))


_AFTER_THINK = duck_strip("substr(txt, strpos(txt, '</think>') + 8)")
_THINK = duck_strip("regexp_extract(txt, '(?s)<think>(.*?)</think>', 1)")


@query("str8_split_generated", VARIED_SQL + f"""
SELECT query_id, resp_idx,
  CASE WHEN contains(txt, '<think>') AND contains(txt, '</think>') THEN {_THINK}
       WHEN contains(txt, '####') THEN {duck_strip("split_part(txt, '####', 1)")}
       ELSE substr(txt, 1, length(txt) // 2) END AS think,
  CASE WHEN contains(txt, '<think>') AND contains(txt, '</think>')
         THEN coalesce(nullif({_AFTER_THINK}, ''), 'No explicit answer provided')
       WHEN contains(txt, '####') THEN '####' || split_part(txt, '####', 2)
       ELSE substr(txt, length(txt) // 2 + 1) END AS answer
FROM varied""")
def _(spark, root):
    parts = text.split_generated(F.col("txt"), F.lit("math"))
    return varied(spark, root).withColumn("p", parts).select(*KEYS, "p.think", "p.answer")


@query("str8_split_generated_code", VARIED_SQL + f"""
SELECT query_id, resp_idx,
  CASE WHEN contains(txt, '<think>') THEN {_THINK}
       WHEN contains(txt, '```python') THEN {duck_strip("split_part(txt, '```python', 1)")}
       ELSE substr(txt, 1, length(txt) // 2) END AS think,
  CASE WHEN contains(txt, '<think>') THEN coalesce(nullif({_AFTER_THINK}, ''), 'No explicit answer provided')
       WHEN contains(txt, '```python') THEN '```python' || split_part(txt, '```python', 2)
       ELSE substr(txt, length(txt) // 2 + 1) END AS answer
FROM varied""")
def _(spark, root):
    parts = text.split_generated(F.col("txt"), F.lit("code"))
    return varied(spark, root).withColumn("p", parts).select(*KEYS, "p.think", "p.answer")


@query("str9_split_scored", VARIED_SQL + f"""
SELECT query_id, resp_idx,
  CASE WHEN contains(txt, '####') THEN {duck_strip("split_part(txt, '####', 1)")} ELSE txt END AS think,
  CASE WHEN contains(txt, '####') THEN {duck_strip("split_part(txt, '####', 2)")} ELSE txt END AS answer
FROM varied""")
def _(spark, root):
    parts = text.split_scored(F.col("txt"))
    return varied(spark, root).withColumn("p", parts).select(*KEYS, "p.think", "p.answer")


@query("str9_split_chat_answers", f"""
SELECT conv_id, turn, text AS think, text AS answer FROM conversations WHERE role = 'assistant'""")
def _(spark, root):
    turns = feeds.table(spark, root, "conversations").where(F.col("role") == "assistant")
    return turns.withColumn("p", text.split_scored(F.col("text"))).select("conv_id", "turn", "p.think", "p.answer")


@query("str10_split_tagged", VARIED_SQL + f"""
SELECT query_id, resp_idx,
  CASE WHEN contains(txt, '<think>') AND contains(txt, '</think>') THEN {_THINK} ELSE '' END AS think,
  CASE WHEN contains(txt, '<think>') AND contains(txt, '</think>') THEN {_AFTER_THINK} ELSE txt END AS answer,
  CASE WHEN contains(txt, '<answer>') THEN {duck_strip("regexp_extract(txt, '(?s)<answer>(.*?)</answer>', 1)")}
       WHEN contains(txt, '####') THEN coalesce(nullif({duck_strip(f'regexp_extract(txt, {HASH}, 1)')}, ''),
         list_filter(list_transform(string_split(txt, '####')[2:], lambda p: {duck_strip('split_part(' + duck_strip('p') + ', chr(10), 1)')}),
           lambda p: p <> '' AND NOT starts_with(p, '#'))[1]) END AS tagged
FROM varied""")
def _(spark, root):
    return varied(spark, root).withColumn("p", text.split_tagged(F.col("txt"))).select(
        *KEYS, "p.think", "p.answer", text.tagged_answer(F.col("txt")).alias("tagged"))


@query("str11_core_text", """
SELECT p_partkey, CASE p_partkey % 4
  WHEN 0 THEN 'SMILES: ' || p_name || ' | Sequence: ' || p_brand WHEN 1 THEN 'Sequence: ' || p_brand
  WHEN 2 THEN 'SMILES: ' || p_name ELSE p_name END AS core FROM part""")
def _(spark, root):
    part = feeds.table(spark, root, "part")
    smiles = F.concat(F.lit("Drug\nSMILES:  "), F.col("p_name"), F.lit("\n"))
    sequence = F.concat(F.lit("Protein Sequence: "), F.col("p_brand"), F.lit("\nend"))
    shape = F.col("p_partkey") % 4
    built = (
        F.when(shape == 0, F.concat(smiles, sequence)).when(shape == 1, sequence)
        .when(shape == 2, smiles).otherwise(F.col("p_name"))
    )
    return part.withColumn("t", built).select("p_partkey", text.core_text(F.col("t")).alias("core"))


@query("str12_log_scores", ctes("log_lines") + """
SELECT event_id, CAST(regexp_extract(line, 'step:(\\d+)\\s', 1) AS BIGINT) AS step,
  unnest(regexp_extract_all(line, 'val-core/(\\w+)/(?:acc|reward)/mean@1:([\\d.]+)', 1)) AS dataset,
  CAST(unnest(regexp_extract_all(line, 'val-core/(\\w+)/(?:acc|reward)/mean@1:([\\d.]+)', 2)) AS DOUBLE) AS score
FROM log_lines""")
def _(spark, root):
    lines = feeds.log_lines(spark, root)
    return lines.select(
        "event_id", text.log_step(F.col("line")).alias("step"), F.explode(text.log_scores(F.col("line"))).alias("s")
    ).select("event_id", "step", "s.dataset", "s.score")


_NUM1 = duck_number("c")


@query("num1_normalise", VARIED_SQL + f""",
c AS (SELECT query_id, resp_idx, {duck_clean('txt')} AS c FROM varied),
n AS (SELECT *, {_NUM1} AS num FROM c)
SELECT query_id, resp_idx, round(num, 6) AS num, CASE WHEN num IS NULL THEN c END AS txt FROM n""")
def _(spark, root):
    pairs = varied(spark, root).withColumn("n", numeric.normalise(F.col("txt")))
    return pairs.select(*KEYS, r6(F.col("n.num")).alias("num"), F.col("n.txt").alias("txt"))


@query("num2_normalise_legacy", VARIED_SQL + """,
c AS (SELECT query_id, resp_idx, regexp_replace(lower(replace(replace(txt, chr(92), ''), ' ', '')),
  '(?:dollars?|cents?|\\$|%|degrees?|°)', '', 'g') AS c FROM varied)
SELECT query_id, resp_idx, coalesce(replace(nullif(regexp_extract(c, '-?\\d+(?:,\\d{3})*(?:\\.\\d+)?', 0), ''), ',', ''), c) AS answer
FROM c""")
def _(spark, root):
    return varied(spark, root).select(*KEYS, numeric.normalise_legacy(F.col("txt")).alias("answer"))


@query("num3_normalise_generalization", VARIED_SQL + f""",
c AS (SELECT query_id, resp_idx, {duck_clean_generalization('txt')} AS c FROM varied),
n AS (SELECT *, {_NUM1} AS num FROM c)
SELECT query_id, resp_idx, round(num, 6) AS num, CASE WHEN num IS NULL THEN c END AS txt FROM n""")
def _(spark, root):
    pairs = varied(spark, root).withColumn("n", numeric.normalise_generalization(F.col("txt")))
    return pairs.select(*KEYS, r6(F.col("n.num")).alias("num"), F.col("n.txt").alias("txt"))


def duck_numeric_answer(x: str) -> str:
    return (
        f"coalesce(TRY_CAST(replace(nullif(regexp_extract({x}, '####\\s*(-?[\\d,]+\\.?\\d*)', 1), ''), ',', '') AS DOUBLE),"
        f" TRY_CAST(replace(nullif(regexp_extract({x}, '\\\\boxed\\{{([^}}]+)\\}}', 1), ''), ',', '') AS DOUBLE),"
        f" TRY_CAST(replace(regexp_extract_all({x}, '-?[\\d,]+\\.?\\d*')[-1], ',', '') AS DOUBLE))"
    )


@query("num4_numeric_answer", VARIED_SQL + f"SELECT query_id, resp_idx, {duck_numeric_answer('txt')} AS answer FROM varied")
def _(spark, root):
    return varied(spark, root).select(*KEYS, numeric.numeric_answer(F.col("txt")).alias("answer"))


@query("num5_numeric_functions", """
SELECT vec_id, round(1 / (1 + exp(-x)), 6) AS sigmoid,
  round(greatest(-1, least(1, sign(x) * ln(1 + abs(x)) / 20)), 6) + 0.0::DOUBLE AS scaled,
  round(list_cosine_similarity(e, list_reverse(e)), 6) + 0.0::DOUBLE AS cosine, round(sqrt(list_dot_product(e, e)), 6) AS norm
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (vec_id % 11 - 5) * 1.5::DOUBLE AS x FROM embeddings)""")
def _(spark, root):
    e = F.col("e")
    rows = feeds.table(spark, root, "embeddings").select(
        "vec_id", as_double(F.col("embedding")).alias("e"), ((F.col("vec_id") % 11 - 5) * 1.5).alias("x"))
    return rows.select(
        "vec_id", r6(numeric.sigmoid(F.col("x"))).alias("sigmoid"), r6(numeric.log_scaled(F.col("x"))).alias("scaled"),
        r6(cosine(e, F.reverse(e))).alias("cosine"), r6(norm(e)).alias("norm"))


@query("jsn1_json_map", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
  CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0 ELSE len(json_keys(props)) END AS entries
FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS props FROM events)""")
def _(spark, root):
    props = F.when(F.col("event_id") % 5 == 0, "not json").when(F.col("event_id") % 7 != 0, F.col("props"))
    rows = feeds.table(spark, root, "events").select("event_id", parse_extra(props).alias("m"))
    return rows.select("event_id", entry(F.col("m"), "k").alias("k"), F.size("m").cast("bigint").alias("entries"))


@query("arr1_array_helpers", """
SELECT vec_id, array_to_string(list_transform(range(0, 3), lambda i: chr(CAST(65 + i AS INTEGER)) || '. ' || CAST((vec_id + i) % 10 AS VARCHAR)), chr(10)) AS joined,
  len(list_filter(embedding, lambda x: x > 0)) AS positive, unnest(['first', 'second']) AS part
FROM embeddings""")
def _(spark, root):
    rows = feeds.table(spark, root, "embeddings")
    key = F.col("vec_id")
    labels = F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D"))
    values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((key + i) % 10).cast("string"))
    joined = F.array_join(F.slice(F.zip_with(labels, values, lambda a, b: F.concat(a, F.lit(". "), b)), 1, 3), "\n")
    return rows.select(
        "vec_id", joined.alias("joined"),
        F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("positive"),
        F.explode(F.array(F.lit("first"), F.lit("second"))).alias("part"))


@query("dom1_domain_mappers", """
WITH n AS (SELECT DISTINCT source, CASE CAST(substr(source, 4) AS INTEGER) % 10 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'MATH' WHEN 2 THEN 'mmlu'
  WHEN 3 THEN 'piqa' WHEN 4 THEN 'mbpp_plus' WHEN 5 THEN 'musique' WHEN 6 THEN 'arc-c' WHEN 7 THEN 'gpqa_train'
  WHEN 8 THEN 'apps' ELSE 'other' END AS name FROM documents)
SELECT source, name,
  CASE WHEN name IN ('gsm8k', 'MATH') THEN 'math' WHEN name IN ('mmlu', 'piqa', 'musique', 'arc-c', 'gpqa_train') THEN 'qa'
       WHEN name IN ('mbpp_plus', 'apps') THEN 'code' ELSE 'math' END AS scoring,
  CASE WHEN name IN ('gsm8k', 'MATH') THEN 'math' WHEN name IN ('mbpp_plus', 'apps') THEN 'coding' ELSE 'qa' END AS gt_only,
  CASE WHEN name IN ('mmlu', 'piqa', 'gpqa_train') THEN 'qa' WHEN name IN ('mbpp_plus', 'apps') THEN 'code' ELSE 'math' END AS memory,
  CASE WHEN name IN ('mmlu', 'gpqa_train') THEN 'qa' WHEN name = 'mbpp_plus' THEN 'code' ELSE 'math' END AS cache
FROM n""")
def _(spark, root):
    number = F.substr("source", F.lit(4)).cast("int") % 10
    names = ["gsm8k", "MATH", "mmlu", "piqa", "mbpp_plus", "musique", "arc-c", "gpqa_train", "apps", "other"]
    picked = F.element_at(F.array(*[F.lit(n) for n in names]), number + 1)
    sources = feeds.table(spark, root, "documents").select("source").distinct().withColumn("name", picked)
    name = F.col("name")
    return sources.select(
        "source", "name", scoring_domain(name).alias("scoring"), gt_only_domain(name).alias("gt_only"),
        memory_domain(name).alias("memory"), cache_domain(name).alias("cache"))
