"""Readers for the reference file shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rewardloom.functions.domains import as_identifier, contains_any, gt_key_domain
from rewardloom.schema import GENERALIZATION_SETS, NODE, QUERY, ROLLOUT_ARRAY, STANDARD_EXCLUDED


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that exist on whatever file system they name."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        handle = jvm.org.apache.hadoop.fs.Path(path)
        if handle.getFileSystem(conf).exists(handle):
            found.append(path)
    return found


def read_splits(spark: SparkSession, files: dict[tuple[str, str], str]) -> DataFrame:
    """Union of the split files present, tagged with ``dataset`` and ``split``.

    ``files`` maps (dataset, split) to a path; missing files are skipped.
    """
    present = set(existing_paths(spark, list(files.values())))
    merged = None
    for (dataset, split), path in files.items():
        if path not in present:
            continue
        part = spark.read.parquet(path).withColumns({"dataset": F.lit(dataset), "split": F.lit(split)})
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    if merged is None:
        raise FileNotFoundError("none of the split files exists")
    return merged


def read_queries(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(QUERY).parquet(*existing_paths(spark, list(paths)))


def read_rollouts(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rollout lists in JSON lines, exploded to one row per response.

    ``multiline`` reads JSON arrays, each of which is one unsplittable record.
    """
    raw = spark.read.schema(ROLLOUT_ARRAY).json(path, multiLine=multiline)
    return explode_rollouts(raw)


def explode_rollouts(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("query_idx").alias("query_id"), "domain", "extra_info",
        F.posexplode("responses").alias("resp_idx", "response"),
    ).withColumn("resp_idx", F.col("resp_idx").cast("bigint"))


def read_first(spark: SparkSession, candidates: list[str], schema: StructType | None = None) -> DataFrame:
    """Parquet table at the first candidate path that exists."""
    found = existing_paths(spark, candidates)
    if not found:
        raise FileNotFoundError(f"no table at {candidates}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(found[0])


def read_nodes(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """Node table under either of its file names, the first one found."""
    return read_first(spark, candidates, NODE)


def read_gt_ids(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Ground-truth ids, one (dataset, identifier, domain) per id.

    Each line is a JSON object of the same shape, so a large list is cut into many
    rows; ``multiline`` reads files that are one object each.
    """
    return parse_gt_ids(spark.read.text(path, wholetext=multiline), F.col("value"))


def parse_gt_ids(files: DataFrame, text: Column) -> DataFrame:
    """A key holds either a bare list of ids or an object with ``indices``."""
    wrapped = F.from_json(text, "map<string,string>")
    body = F.col("entry.value")
    ids = F.coalesce(
        F.from_json(F.get_json_object(body, "$.indices"), "array<string>"),
        F.when(F.ltrim(body).startswith("["), F.from_json(body, "array<string>")),
    )
    return (
        files.select(F.explode(F.map_entries(wrapped)).alias("entry"))
        .select(F.lower("entry.key").alias("dataset"), F.explode(ids).alias("raw"))
        .select("dataset", as_identifier(F.col("raw")).alias("identifier"),
                gt_key_domain(F.col("dataset")).alias("domain"))
        .where(F.col("domain").isNotNull())
        .distinct()
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Training-log lines with the file they came from."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")
    )


def keep_test_sets(files: DataFrame, name: Column, kind: str) -> DataFrame:
    """Test sets of one kind, by name: a keep list or a drop list."""
    low = F.lower(name)
    if kind == "generalization":
        return files.where(contains_any(low, GENERALIZATION_SETS))
    return files.where(~contains_any(low, STANDARD_EXCLUDED))


def read_test_sets(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All ``*_test.parquet`` files or folders of a kind, tagged with their dataset."""
    raw = spark.read.parquet(f"{folder}/*_test.parquet")
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+_test)\.parquet(?:/[^/]+)?$", 1)
    named = raw.withColumn("dataset", F.regexp_replace(stem, "_sampled_test$", ""))
    return keep_test_sets(named, F.col("dataset"), kind)
