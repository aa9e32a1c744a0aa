"""A training corpus from raw documents: quality, lines, near copies, benchmarks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.llm import decontaminate, lines, near, pieces, quality
from rewardloom.llm.queries import piece_model, table
from rewardloom.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and meet none of the learned rejecting rules."""
    rules = quality.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.judged_quality(docs, rules).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; a document that was nothing else goes."""
    judged = lines.without_boilerplate(docs)
    left = judged.filter((F.col("lines.n_removed") == 0) | F.col("lines.text").rlike(r"[^\x20\x09-\x0D]"))
    cut = left.withColumn("text", F.col("lines.text")).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id; repeated rows become one.

    Documents without an id are named by no class and stay.
    """
    kept = near.near_duplicates(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    chosen = docs.join(kept, F.col("doc_id") == F.col("kept_id")).drop("kept_id")
    once = chosen.withColumn("_content", F.xxhash64("text")).dropDuplicates(["doc_id", "_content"])
    return once.select(*COLUMNS).union(docs.filter("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter(~F.col("hits.contaminated")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and whether decoding them gives the text back."""
    done = pieces.encoded(docs, piece_model())
    return done.select(
        *COLUMNS, F.size("pieces.ids").cast("long").alias("n_tokens"), "pieces.ids", "pieces.round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The learned rules and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
