"""Raw benchmark tables into the canonical query layout, one projection each."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import prompts, text

MATH_MARKER = "math_reward"


def _query(df: DataFrame, source: Column, prompt: Column, ability: str, truth: Column, index: Column,
           answer: Column, question: Column | None = None, tests: Column | None = None,
           **attrs: Column) -> DataFrame:
    """The canonical columns; what is left over goes to a string map."""
    pairs = [x for name, value in attrs.items() for x in (F.lit(name), value.cast("string"))]
    extra = F.struct(
        answer.alias("answer"),
        index.cast("bigint").alias("index"),
        F.lit(None).cast("string").alias("split"),
        (F.lit(None).cast("string") if question is None else question).alias("question"),
        (F.lit(None).cast("array<string>") if tests is None else tests).alias("test_list"),
        F.lit(None).cast("boolean").alias("is_train"),
        (F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")).alias("attrs"),
    )
    return df.select(
        source.alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(truth.cast("string").alias("ground_truth")).alias("reward_model"), extra.alias("extra_info"),
    )


def after_last_marker(answer: Column) -> Column:
    """Text behind the last ``####``; the whole text where there is none."""
    return text.strip(F.element_at(text.segments(answer, "####"), -1))


def gsm8k(df: DataFrame) -> DataFrame:
    final = after_last_marker(F.col("answer"))
    return _query(df, F.lit("gsm8k"), prompts.templated("gsm8k", F.col("question")), "math", final,
                  F.col("index"), final, full_answer=F.col("answer"))


def gsm_symbolic(df: DataFrame, variant: str = "main") -> DataFrame:
    final = after_last_marker(F.col("answer"))
    return _query(df, F.lit(f"gsm_symbolic_{variant}"), prompts.templated("gsm8k", F.col("question")), "math",
                  final, F.col("index"), final, question=F.col("question"),
                  template_id=F.coalesce(F.col("template_id"), F.col("index")),
                  instance_id=F.coalesce(F.col("instance_id"), F.lit(0)))


def task_description(prompt: Column, entry_point: Column) -> Column:
    """Text of the first docstring, or a generic request."""
    found = text.strip(text.group(prompt, text.DOCSTRING))
    return F.coalesce(found, F.concat(F.lit("Complete the function "), entry_point))


def test_assertions(tests: Column, entry_point: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(tests, F.lit(text.ASSERT), F.lit(0)),
        lambda line: F.replace(line, F.lit("candidate"), entry_point),
    )


def humaneval(df: DataFrame) -> DataFrame:
    tests = test_assertions(F.coalesce(F.col("test"), F.lit("")), F.col("entry_point"))
    task = F.concat(task_description(F.col("prompt"), F.col("entry_point")),
                    F.lit("\n\nFunction signature:\n"), F.col("prompt"))
    solution = F.concat(F.col("prompt"), F.coalesce(F.col("canonical_solution"), F.lit("")))
    return _query(df, F.lit("humaneval_plus"), prompts.templated("code", task, tests=tests), "coding",
                  solution, F.col("index"), solution, tests=tests, task_id=F.col("task_id"),
                  entry_point=F.col("entry_point"))


def mbpp(df: DataFrame) -> DataFrame:
    task = F.coalesce(F.col("text"), F.col("prompt"), F.lit(""))
    solution = F.coalesce(F.col("code"), F.col("canonical_solution"), F.lit(""))
    tests = F.coalesce(F.col("test_list"), F.array().cast("array<string>"))
    return _query(df, F.lit("mbpp_plus"), prompts.templated("code", task, tests=tests), "coding",
                  solution, F.col("index"), solution, tests=tests)


def labelled_choices(labels: Column, texts: Column) -> Column:
    """``L. text`` lines from parallel label and text arrays."""
    return F.array_join(F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(". "), b)), "\n")


def lettered_choices(choices: Column) -> Column:
    """``L. text`` lines with letters from the position."""
    return F.array_join(
        F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c)), "\n"
    )


def multiple_choice(df: DataFrame, source: str) -> DataFrame:
    """Data sets that carry labels beside the choices."""
    listed = labelled_choices(F.col("labels"), F.col("choices"))
    return _query(df, F.lit(source), prompts.templated("mcq", F.col("question"), choices=listed), "qa",
                  F.col("answer"), F.col("index"), F.col("answer"), question=F.col("question"), choices=listed)


def mmlu(df: DataFrame) -> DataFrame:
    """Answer index to letter. A subject listed twice keeps its duplicates."""
    listed = lettered_choices(F.col("choices"))
    answer = F.char(F.lit(65) + F.col("answer"))
    return _query(df, F.lit("mmlu"), prompts.templated("mcq", F.col("question"), choices=listed), "qa",
                  answer, F.col("index"), answer, question=F.col("question"), subject=F.col("subject"))


def shuffled_answers(answers: Column, key: Column, seed: int = 42) -> Column:
    """Non-empty answers in an order fixed by the row's key."""
    kept = F.filter(answers, lambda a: F.coalesce(a, F.lit("")) != "")
    keyed = F.transform(kept, lambda a, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))).alias("k"), a.alias("a")
    ))
    return F.transform(F.array_sort(keyed), lambda p: p["a"])


def letter_of(answers: Column, correct: Column, default: str | None = None) -> Column:
    place = F.array_position(answers, correct)
    return F.when(place > 0, F.char(F.lit(64) + place)).otherwise(F.lit(default))


def gpqa(df: DataFrame, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Shuffled per row, or in the given order with ``A`` where nothing matches."""
    if shuffle:
        order = shuffled_answers(F.col("answers"), F.col("index"), seed)
        letter = letter_of(order, F.col("correct"))
    else:
        order, letter = F.col("answers"), letter_of(F.col("answers"), F.col("correct"), "A")
    listed = lettered_choices(order)
    return _query(df, F.lit("gpqa"), prompts.templated("mcq", F.col("question"), choices=listed), "qa",
                  letter, F.col("index"), letter, question=F.col("question"), choices=listed)


def competition_math(df: DataFrame) -> DataFrame:
    """Answer from the last box; the reward model holds only a marker."""
    answer = text.last_boxed(F.col("solution"))
    return _query(df, F.lit("math"), prompts.templated("math_competition", F.col("problem")), "math",
                  F.lit(MATH_MARKER), F.col("index"), answer, solution=F.col("solution"),
                  level=F.col("level"), type=F.col("type"))


def numina_answer(solution: Column) -> Column:
    """First box (cut at its first brace), else behind the last marker, else the last line."""
    boxed = text.group(solution, text.BOXED_SIMPLE)
    marked = F.when(F.contains(solution, F.lit("####")), after_last_marker(solution))
    last_line = text.strip(F.element_at(F.split(text.strip(solution), "\n", -1), -1))
    return F.coalesce(boxed, marked, last_line)


def numina(df: DataFrame) -> DataFrame:
    answer = numina_answer(F.col("solution"))
    return _query(df, F.lit("numina_math"), prompts.templated("math_competition", F.col("problem")), "math",
                  answer, F.col("index"), answer, question=F.col("problem"), solution=F.col("solution"))


def context_choices(df: DataFrame, source: str, first_label: int) -> DataFrame:
    """Context questions: labels count from ``first_label``; empty choices drop out."""
    kept = F.filter(F.col("choices"), lambda c: F.coalesce(c, F.lit("")) != "")
    listed = lettered_choices(kept)
    letter = F.char(F.lit(65 - first_label) + F.col("label"))
    return _query(df, F.lit(source),
                  prompts.templated("mcqa", F.col("question"), context=F.col("context"), choices=listed), "qa",
                  letter, F.col("index"), letter, question=F.col("question"), context=F.col("context"))


def normalised_reward_model(reward_model: Column, extra: Column) -> Column:
    """Struct form of a reward model given as JSON, marker, text or null.

    ``extra`` is a string map; a marker that names math takes its answer.
    """
    inside = F.get_json_object(reward_model, "$.ground_truth")
    is_object = F.from_json(reward_model, "map<string,string>").isNotNull() & F.contains(
        reward_model, F.lit("ground_truth"))
    quoted = reward_model.rlike(r'^\s*".*"\s*$')
    plain = F.when(quoted, F.get_json_object(F.concat(F.lit("["), reward_model, F.lit("]")), "$[0]")).otherwise(
        reward_model)
    marker = F.contains(F.lower(plain), F.lit("math"))
    answer = F.coalesce(F.try_element_at(extra, F.lit("answer")), F.lit(""))
    truth = (
        F.when(reward_model.isNull(), "").when(is_object, inside).when(marker, answer).otherwise(plain)
    )
    return F.struct(truth.alias("ground_truth"))


def repaired_reward_model(reward_model: Column, extra: Column) -> Column:
    """Repair variant: a marker needs both words, and other bare text is dropped."""
    inside = F.coalesce(F.get_json_object(reward_model, "$.ground_truth"), F.lit(""))
    is_object = F.from_json(reward_model, "map<string,string>").isNotNull() & F.ltrim(reward_model).startswith("{")
    low = F.lower(reward_model)
    marker = F.contains(low, F.lit("math")) & F.contains(low, F.lit("reward"))
    answer = F.coalesce(F.try_element_at(extra, F.lit("answer")), F.lit(""))
    number = F.when(reward_model.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.trim(reward_model))
    truth = (
        F.when(reward_model.isNull(), "").when(is_object, inside).when(marker, answer)
        .otherwise(F.coalesce(number, F.lit("")))
    )
    return F.struct(truth.alias("ground_truth"))


def flag_training(df: DataFrame, is_train: Column) -> DataFrame:
    """Training flag as a column and inside ``extra_info``."""
    return df.withColumn("is_train", is_train).withColumn(
        "extra_info", F.col("extra_info").withField("is_train", is_train)
    )


def resolved_extra(extra: Column, answer: Column, answer_key: Column) -> Column:
    """JSON where given, else a map from columns; ``answerKey`` overrides ``answer``."""
    built = F.map_filter(
        F.create_map(F.lit("answer"), F.coalesce(answer_key, answer)), lambda k, v: v.isNotNull()
    )
    return F.when(extra.isNotNull(), F.coalesce(F.from_json(extra, "map<string,string>"),
                                                F.expr("map()").cast("map<string,string>"))).otherwise(built)


def encoder_inputs(query: Column, think: Column, answer: Column, lengths: tuple[int, int, int] | None = None
                   ) -> list[Column]:
    """Texts as the encoder takes them, whole unless ``lengths`` states its input limits."""
    texts = [query, think, answer]
    if lengths is not None:
        texts = [F.substr(t, F.lit(1), F.lit(n)) for t, n in zip(texts, lengths, strict=True)]
    return [t.alias(n) for t, n in zip(texts, ("query_text", "think_text", "answer_text"), strict=True)]


def encode_text(df: DataFrame, column: str, size: int = 256, idf: bool = True) -> DataFrame:
    """Hashed-word vectors of whole texts: counts, inverse document frequencies, unit length.

    A word's place is the number in its first four MD5 digits modulo ``size``, so that
    any engine finds the same vector. Frequencies are fitted over all rows by one
    aggregate of ``size`` numbers. A null text, or one without words, is a zero vector.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    place = lambda w: (F.conv(F.substr(F.md5(w), F.lit(1), F.lit(4)), 16, 10).cast("int") % size).cast("string")
    placed = df.withColumn("_places", F.transform(words, place))
    counter = CountVectorizerModel.from_vocabulary([str(n) for n in range(size)], inputCol="_places", outputCol="_tf")
    vectors = counter.transform(placed)
    source = "_tf"
    if idf:
        vectors = IDF(inputCol="_tf", outputCol="_idf").fit(vectors).transform(vectors)
        source = "_idf"
    scaled = Normalizer(inputCol=source, outputCol="_unit").transform(vectors)
    return scaled.withColumn("embedding", vector_to_array("_unit")).drop("_places", "_tf", "_idf", "_unit")
