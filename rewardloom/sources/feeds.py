"""Feeds: the driver's tables reshaped into queries, rollouts, vectors and logs.

Rollout ids are derived from the row itself (60 bits of an MD5), so building the
feed needs no window and no shuffle beyond its own key joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.functions.vectors import as_double


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spreads a scan over the cores where its files give fewer partitions.

    Large tables have far more partitions than this needs and pass unchanged.
    Only for plain scans, whose partition count is known without running them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hash_id(*parts: Column) -> Column:
    """60-bit id from the text of some columns, equal in every SQL engine."""
    digest = F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))
    return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def letter(base: int, offset: Column) -> Column:
    return F.char(F.lit(base) + offset)


def queries(spark: SparkSession, root: str) -> DataFrame:
    """One row per order: source, id and ground truth."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    source = (
        F.when(F.col("c_mktsegment") == "BUILDING", "gsm8k")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "math")
        .when(F.col("c_mktsegment") == "MACHINERY", "mmlu")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "arc_c")
        .otherwise("gsm_symbolic_main")
    )
    key = F.col("o_orderkey")
    truth = F.when(
        F.col("data_source").isin("mmlu", "arc_c"), letter(65, (key % 5).cast("int"))
    ).otherwise((key % 4).cast("string"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn("data_source", source)
        .select("data_source", key.alias("query_id"), truth.alias("ground_truth"))
    )


def rollouts(spark: SparkSession, root: str) -> DataFrame:
    """One row per order line, joined to its query's ground truth."""
    return shape_rollouts(spread(table(spark, root, "lineitem")), queries(spark, root))


def shape_rollouts(lines: DataFrame, owners: DataFrame) -> DataFrame:
    """Order lines, from a table or a stream, as rollouts."""
    agrees = F.col("l_partkey") % 7 < 4  # these rows repeat their query's answer
    picked = lines.select(
        F.col("l_orderkey").alias("query_id"),
        hash_id(
            F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
            F.col("l_quantity").cast("bigint"), _cents("l_extendedprice"), _cents("l_discount"),
            _cents("l_tax"), F.date_format("l_shipdate", "yyyy-MM-dd"),
            F.col("l_returnflag"), F.col("l_linestatus"),
        ).alias("resp_idx"),
        F.when(agrees, F.col("l_orderkey") % 4).otherwise(F.col("l_quantity").cast("bigint") % 4).alias("q"),
        (F.col("l_partkey") % 5).cast("int").alias("f"),
        F.when(agrees, F.col("l_orderkey") % 5).otherwise(F.col("l_linenumber") % 5).cast("int").alias("n"),
    )
    q, f, n = F.col("q"), F.col("f"), F.col("n")
    worded = (
        F.when(f == 0, F.concat(F.lit("Reason. #### "), letter(65, n)))
        .when(f == 1, F.concat(F.lit("The correct answer is: "), letter(65, n), F.lit(".")))
        .when(f == 2, F.concat(F.lit("I pick "), letter(65, n)))
        .when(f == 3, F.concat(F.lit("#### "), letter(97, n)))
        .otherwise("not sure")
    )
    text = q.cast("string")
    numeric = (
        F.when(f == 0, F.concat(F.lit("Step one. #### "), text))
        .when(f == 1, F.concat(F.lit("So \\boxed{"), text, F.lit("}")))
        .when(f == 2, F.concat(F.lit("#### "), text, F.lit(" dollars.")))
        .when(f == 3, F.concat(F.lit("#### \\frac{"), (q * 2).cast("string"), F.lit("}{2}")))
        .otherwise(F.concat(F.lit("I get "), text))
    )
    return picked.join(owners, "query_id").select(
        "data_source", "query_id", "resp_idx", "ground_truth",
        F.when(F.col("data_source").isin("mmlu", "arc_c"), worded).otherwise(numeric).alias("response"),
    )


def rollouts_with_extra(spark: SparkSession, root: str) -> DataFrame:
    return with_extra(rollouts(spark, root))


def with_extra(rows: DataFrame) -> DataFrame:
    """Rollouts with a JSON ``extra_info`` in its three usual shapes."""
    key = F.col("query_id")
    is_train = F.when(key % 1000 == 7, "false").otherwise("true")
    shape = key % 3
    answer = F.concat(F.lit('"answer":"'), F.col("ground_truth"), F.lit('",'))
    middle = (
        F.when(shape == 0, F.concat(F.lit('"question":"Question '), key.cast("string"), F.lit('",')))
        .when(shape == 1, answer)
        .otherwise(F.concat(answer, F.lit('"question":"",')))
    )
    extra = F.concat(
        F.lit('{"index":'), key.cast("string"), F.lit(","), middle,
        F.lit('"is_train":'), is_train, F.lit("}"),
    )
    return rows.withColumn("extra_info", extra).withColumn(
        "batch_id", F.floor(key / 100)
    )


def gt_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids of the labelled fifth of the queries, keyed by dataset."""
    return (
        queries(spark, root)
        .where(F.col("query_id") % 5 == 0)
        .select(
            F.when(F.col("data_source") == "gsm_symbolic_main", "gsm_symbolic")
            .otherwise(F.col("data_source")).alias("dataset"),
            F.col("query_id").cast("string").alias("identifier"),
        )
    )


def query_vectors(spark: SparkSession, root: str) -> DataFrame:
    """A vector per order. Many orders share one, which is the copy-heavy case."""
    vectors = table(spark, root, "embeddings")
    count = vectors.agg(F.count("*")).scalar()
    return (
        queries(spark, root)
        .withColumn("vec_id", F.col("query_id") % count)
        .join(vectors.select("vec_id", as_double(F.col("embedding")).alias("embedding")), "vec_id")
        .select("data_source", "query_id", "embedding")
    )


def query_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Vectors as query nodes: domain by label, four fifths are memory."""
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.element_at(
            F.array(F.lit("math"), F.lit("qa"), F.lit("code")), (F.col("label") % 3 + 1).cast("int")
        ).alias("domain"),
        (F.col("vec_id") % 5 != 0).alias("is_memory"),
        as_double(F.col("embedding")).alias("embedding"),
        F.col("label"),
    )


def rollout_nodes(spark: SparkSession, root: str) -> DataFrame:
    """Vectors as rollout nodes, eight to a query; the label gives the reward."""
    return table(spark, root, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("query_id"),
        (F.col("vec_id") % 8).alias("resp_idx"),
        F.col("vec_id").alias("node_id"),
        as_double(F.col("embedding")).alias("embedding"),
        F.col("label"),
        F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0).alias("reward"),
    )


def labelled_documents(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents").drop("text")
    labels = table(spark, root, "labels")
    return documents.join(labels, "doc_id", "left").withColumn(
        "route", F.when(F.col("quality").isNull(), "graph").otherwise("gt")
    )


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """Training-log lines written from events."""
    value = (F.floor("value").cast("int") % 100).cast("string")
    return table(spark, root, "events").select(
        "event_id",
        F.concat(
            F.lit("step:"), (F.col("event_id") % 40).cast("string"), F.lit(" - val-core/"),
            F.col("event_type"), F.lit("/acc/mean@1:"), value,
            F.lit(" - val-core/gsm8k/reward/mean@1:0."), (F.lit(10) + F.col("user_id") % 90).cast("string"),
        ).alias("line"),
    )


def chats(spark: SparkSession, root: str) -> DataFrame:
    """One row per conversation with all its system and user turns, in order, as the prompt."""
    turns = table(spark, root, "conversations")
    asked = F.col("role").isin("system", "user")
    message = F.struct("turn", "role", F.col("text").alias("content"))
    prompt = F.array_sort(F.collect_list(F.when(asked, message)))
    return turns.groupBy("conv_id").agg(prompt.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("prompt"))


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Events as scored rollouts: a probability and a binary reward per row."""
    return table(spark, root, "events").select(
        F.col("event_type").alias("dataset"),
        (F.col("user_id")).alias("query_id"),
        F.col("event_id").alias("resp_idx"),
        (F.floor(F.col("value")) / 500.0).alias("prob"),
        F.when((F.col("event_id") * 7 + F.floor("value").cast("bigint")) % 5 < 2, 1.0)
        .otherwise(0.0).alias("reward"),
    )


def epoch_history(spark: SparkSession, root: str) -> DataFrame:
    """Validation metric per run and epoch, averaged from events."""
    return (
        table(spark, root, "events")
        .groupBy((F.col("user_id") % 20).alias("run"), (F.col("event_id") % 25 + 1).alias("epoch"))
        .agg(F.round(F.avg(F.floor("value") / 500.0), 6).alias("metric"))
    )


def stream_of(spark: SparkSession, folder: str, name: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Stream over the parquet files of a folder whose names match a pattern."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", name).parquet(folder)


def shape_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("resp_idx"),
        F.col("user_id").alias("query_id"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("reward"),
    )
