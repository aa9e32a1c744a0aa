"""Table schemas and the fixed lookup values they rely on."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

REWARD_MODEL = T.StructType([T.StructField("ground_truth", T.StringType())])

EXTRA_INFO = T.StructType([
    T.StructField("answer", T.StringType()),
    T.StructField("index", T.LongType()),
    T.StructField("split", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("test_list", T.ArrayType(T.StringType())),
    T.StructField("is_train", T.BooleanType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

QUERY = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("prompt", T.ArrayType(MESSAGE)),
    T.StructField("ability", T.StringType()),
    T.StructField("reward_model", REWARD_MODEL),
    T.StructField("extra_info", EXTRA_INFO),
])

ROLLOUT_ARRAY = T.StructType([
    T.StructField("query_idx", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("responses", T.ArrayType(T.StringType())),
    T.StructField("extra_info", T.MapType(T.StringType(), T.StringType())),
])

NODE = T.StructType([
    T.StructField("node_type", T.StringType()),
    T.StructField("query_id", T.LongType()),
    T.StructField("resp_idx", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("is_memory", T.BooleanType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("answer_features", T.ArrayType(T.DoubleType())),
])

# --- fixed values (must equal the published data sets' names and sizes) ------

DATASET_DOMAIN = {
    "gsm8k": "math", "math": "math", "gsm_symbolic": "math",
    "mmlu": "qa", "commonsenseqa": "qa", "obqa": "qa", "arc_c": "qa", "gpqa": "qa",
    "humaneval_plus": "code", "mbpp_plus": "code",
}

GT_KEY_DOMAIN = {
    "gsm8k": "math", "math": "math", "gsm_symbolic": "math", "numina_math": "math",
    "mmlu": "qa", "gpqa": "qa", "commonsenseqa": "qa", "obqa": "qa", "arc_c": "qa",
    "qa": "qa", "siqa": "qa", "piqa": "qa",
    "humaneval_plus": "code", "mbpp_plus": "code", "humaneval": "code",
    "mbpp": "code", "apps": "code",
}

VALIDATION_SIZES = {
    "gsm8k": 300, "mmlu": 300, "math": 300, "humaneval_plus": 26, "mbpp_plus": 52,
    "commonsenseqa": 300, "obqa": 300, "arc_c": 300, "gpqa": 39, "gsm_symbolic": 300,
}

GENERALIZATION_SETS = ["numina_math", "piqa", "siqa"]
STANDARD_EXCLUDED = ["pharma", "tdc", "dti", "numina", "piqa", "siqa"]

# --- end of fixed values -----------------------------------------------------
