"""The registered queries of the operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm import chat, counts, decontaminate, language, lines, near, negatives, pieces, quality, repair, shards, spans, urls

Query = Callable[[SparkSession, str], DataFrame]

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# The rules of the filter, and host words that mark a URL as rejected for training.
URL_RULES = [
    urls.Rule("org", "/", urls.ALLOW), urls.Rule("example.org", "/es/", urls.BLOCK),
    urls.Rule("example.org", "/en/1", urls.BLOCK), urls.Rule("com", "/fr/", urls.ALLOW),
    urls.Rule("com", "/de/", urls.BLOCK),
]
REJECTED_HOST_WORDS = r"(^|[.-])(ads?|bets?|casino|pills|poker|porn|spam|xxx)([.-]|$)"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit_languages(documents.filter(~held_out))
    judged = language.identified(documents.select("doc_id", "text"), model)
    return judged.select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
        (~F.col("language.accepted")).alias("rejected"))


def op2_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "source", "text")
    judged = lines.without_boilerplate(documents)
    return judged.select(
        "doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.col("lines.text"), 256).alias("text_sha256"))


def labelled_urls(pages: DataFrame) -> DataFrame:
    """Training labels: a word in the host rejects; of the rest, what no rule blocks is accepted.

    Blocking rules state a policy on sites and languages, not how a bad URL reads,
    so the URLs that they block teach neither model.
    """
    host, path = urls.host_and_path(F.col("url"))
    blocked = F.coalesce(urls.longest_rule(URL_RULES, host, path)["verdict"] == urls.BLOCK, F.lit(False))
    good = F.when(host.rlike(REJECTED_HOST_WORDS), False).when(~blocked, True)
    return pages.select("url", good.alias("good")).filter("good is not null")


def op3_url_filters(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages").select("page_id", "url")
    models = urls.fit_url_models(labelled_urls(pages))
    return urls.judged_urls(pages, URL_RULES, models).select("page_id", "host", "path", "rule", "verdict", "score")


def piece_model(path: str = PIECE_MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def op5_sentencepiece(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text")
    done = pieces.encoded(documents, piece_model())
    return done.select(
        "doc_id", F.size("pieces.ids").cast("long").alias("n_tokens"), "pieces.ids", "pieces.round_trip")


def op6_token_counts(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text")
    return counts.token_counts(documents, piece_model()).select("doc_id", "n_tokens")


def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text")
    rules = quality.fit_quality_rules(documents, table(spark, root, "labels"))
    judged = quality.judged_quality(documents, rules)
    counts = [f"stats.{name}" for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "rule")


def op7_ngram_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return near.near_duplicates(table(spark, root, "documents").select("doc_id", "text"))


def op8_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    return chat.format_conversations(table(spark, root, "conversations"))


def op9_decontamination(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text")
    judged = decontaminate.contamination(documents, table(spark, root, "benchmark"))
    return judged.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), "hits.contaminated")


def op10_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").select("doc_id", "text")
    judged = spans.remove_repeated_spans(documents, digest=True)
    return judged.select("doc_id", "spans.n_words", "spans.n_removed", F.col("spans.text").alias("kept_sha256"))


def op11_sharding(spark: SparkSession, root: str) -> DataFrame:
    """Law ``rows``: counts of shards differ by one at most. Equal texts are rows like others and spread alike."""
    text = F.coalesce(F.col("text"), F.lit(""))
    documents = table(spark, root, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shards.sharded(documents).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("place.shard").cast("int").alias("shard"),
        "place.slot", F.lit(None).cast("int").alias("grown_shard"), "place.row_number", "place.position")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with a known damage, chosen by a hash of their place; ``dropped`` rows only name their conversation."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20
    turns = conversations.select(
        "conv_id", "turn", kind.alias("kind"), spaced("role").alias("role"), spaced("text").alias("text"))
    return turns.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))


def op12_structure_repair(spark: SparkSession, root: str) -> DataFrame:
    conversations = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repaired(damaged(conversations), dropped=F.col("dropped"))


def op13_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Anchors are the ids divisible by 100; ids divisible by 7 carry a wrong label on purpose."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, root, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sharding": op11_sharding,
    "op12_structure_repair": op12_structure_repair,
    "op13_hard_negatives": op13_hard_negatives,
}


def _network_sql(source: str, column: str, permutation: shards.Permutation) -> str:
    """One pass of the sharding permutation over ``source`` in SQL, with grid sizes taken from table ``grid``."""
    sql = f"SELECT s.*, {column} % wide AS low, {column} // wide AS up, wide, high FROM {source} s, grid"
    for number in range(permutation.rounds):
        half, other, size = ("low", "up", "wide") if number % 2 == 0 else ("up", "low", "high")
        spread = f"({other} + {permutation.key(number)}) % {shards.PRIME} * {shards.FACTOR} % {shards.PRIME}"
        sql = (f"SELECT * REPLACE (({half} + xor(spread, spread >> 15)) % {size} AS {half}) FROM "
               f"(SELECT * EXCLUDE (spread), {spread} AS spread FROM (SELECT *, 0 AS spread FROM ({sql})))")
        sql = f"SELECT * EXCLUDE (spread) FROM ({sql})"
    return sql

_BENCH_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
""",
    "op11_sharding": f"""
WITH RECURSIVE grid AS (
  SELECT count(*) AS total, CAST(greatest(ceil(sqrt(count(*))), 1) AS BIGINT) AS wide,
    CAST(greatest(ceil(count(*) / greatest(ceil(sqrt(count(*))), 1)), 1) AS BIGINT) AS high FROM documents),
rows AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_number FROM documents),
walk AS (
  SELECT row_number, up * wide + low AS place FROM ({_network_sql("rows", "row_number", shards.Permutation(0))})
  UNION ALL
  SELECT row_number, up * wide + low AS place FROM ({_network_sql(
      "(SELECT row_number, place FROM walk, grid WHERE place >= total)", "place", shards.Permutation(0))})),
places AS (SELECT row_number, place AS position FROM walk, grid WHERE place < total),
steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS step),
sums AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(
      regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(step[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM documents, steps)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position % 40 AS INTEGER) AS shard, position // 40 AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, row_number, position
FROM rows JOIN places USING (row_number) JOIN sums USING (doc_id)
""",
    "op2_line_dedup": """
WITH parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS w FROM documents),
numbered AS (SELECT doc_id, source, w, unnest(range(1, len(w) + 1)) AS i FROM parts),
each_line AS (SELECT doc_id, source, i, w[i] AS raw, trim(w[i]) AS line FROM numbered),
spread AS (SELECT line, min(doc_id) AS least FROM each_line WHERE line <> ''
           GROUP BY line HAVING count(DISTINCT source) >= 10),
judged AS (
  SELECT l.doc_id, i, raw,
    s.line IS NULL OR (l.doc_id = least AND i = min(i) OVER (PARTITION BY l.doc_id, l.line)) AS stays
  FROM each_line l LEFT JOIN spread s USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (stays), '')) AS text_sha256
FROM judged GROUP BY doc_id
""",
    "op8_chat_formatting": """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
logged AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns FROM turns GROUP BY conv_id),
kinds AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM logged GROUP BY turns),
begun AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM kinds))
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies,
  list_aggregate(list_transform(turns, lambda t: '<|im_start|>' ||
    replace(coalesce(t.role, 'unknown'), '<|', '< |') || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') ||
    '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM kinds ANTI JOIN begun USING (turns)
""",
    "op9_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, {_BENCH_WORD}) AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, {_BENCH_WORD}) AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, w[i:i + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, size, w[i:i + size - 1] AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op10_substring_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_WORD}), []) AS w FROM documents),
wins AS (
  SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h1, md5_number(array_to_string(w[i:i + 49], ' ')) AS h2
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h1, h2, min(doc_id) AS least FROM wins GROUP BY h1, h2),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM wins JOIN least USING (h1, h2) WHERE doc_id > least)
  GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n_words,
    list_filter(list_zip(range(1, len(w) + 1), w), lambda x: NOT list_contains(coalesce(gone, []), x[1])) AS kept
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_words - len(kept) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(kept, lambda x: x[2]), ' ')) AS kept_sha256
FROM kept
""",
}
