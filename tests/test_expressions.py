"""Literal cases, including the quirks that are kept on purpose."""

import pytest
from pyspark.sql import functions as F

from rewardloom.functions import numeric, text
from rewardloom.functions.domains import cache_domain, memory_domain, scoring_domain
from rewardloom.operators import ingest, scoring


def value(spark, make, *inputs):
    names = [f"c{i}" for i in range(len(inputs))]
    row = spark.createDataFrame([inputs], ", ".join(f"{n} string" for n in names))
    return row.select(make(*[F.col(n) for n in names]).alias("v")).head()["v"]


@pytest.mark.parametrize("given, expected", [
    ("#### 42.", "42"), ("#### 42\nmore", "42"), ("no marker", None), ("####\n\n  7 \nrest", "7"),
    ("#### a #### b", "a"), ("a #### ## #### 5", "##"), ("####\n## x\n#### ...", ""),
])
def test_answer_after_marker(spark, given, expected):
    assert value(spark, text.answer_after_marker, given) == expected


@pytest.mark.parametrize("given, expected", [
    (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{}", ""), ("none", None), (r"\boxed{a{b{c}}", "a{b{c"),
])
def test_boxed_answer(spark, given, expected):
    assert value(spark, text.boxed_answer, given) == expected


@pytest.mark.parametrize("given, expected", [
    (r"a \boxed{1} b \boxed{\frac{a}{b{c}}}", r"\frac{a}{b{c}}"), ("none", "none"), (r"\boxed{x", "x"), (r"\boxed{}z", ""),
])
def test_last_boxed(spark, given, expected):
    assert value(spark, text.last_boxed, given) == expected


@pytest.mark.parametrize("given, expected", [
    ("#### b", "B"), ("The correct answer is: C.", "C"), ("so D", "D"), ("so E", "X"), ("not sure", "X"),
])
def test_choice_letter(spark, given, expected):
    assert value(spark, text.choice_letter, given) == expected


@pytest.mark.parametrize("given, num, txt", [
    (r"\frac{6}{2}", 3.0, None), ("1,000 dollars", 1000.0, None), ("x^2+1", 2.0, None), ("1/0", 1.0, None),
    ("abc", None, "abc"), ("", None, ""), ("7", 7.0, None), ("-2.50", -2.5, None), ("(3)/(4)", 0.75, None),
])
def test_normalise(spark, given, num, txt):
    got = value(spark, numeric.normalise, given)
    assert (got["num"], got["txt"]) == (num, txt)


def test_normalise_generalization_keeps_commas(spark):
    assert value(spark, numeric.normalise_generalization, "1,000")["num"] == 1.0


def test_legacy_rules_never_fire(spark):
    assert value(spark, numeric.normalise_legacy, r"\frac{1,234}{2}") == "1234"


@pytest.mark.parametrize("given, expected", [
    ("a 1,2 b -3.5", -3.5), ("#### ,", None), ("none", None), (r"\boxed{1,000}", 1000.0), ("#### 5 then 9", 5.0),
])
def test_numeric_answer(spark, given, expected):
    assert value(spark, numeric.numeric_answer, given) == expected


@pytest.mark.parametrize("response, truth, expected", [
    ("Let me solve this step by step.\n3 + 5 = 8\n#### 8", "8", 1.0), ("I think 5\n#### 5", "4", 0.0),
    (r"\boxed{}", "", 1.0), ("nothing", "", 0.0), (r"#### \frac{1}{2}", r"\boxed{0.5}", 1.0),
])
def test_math_reward(spark, response, truth, expected):
    assert value(spark, scoring.math_reward, response, truth) == expected


@pytest.mark.parametrize("response, truth, expected", [
    ("The capital of France is Paris.\n#### A", "A", 1.0), ("The answer is Paris", "Paris", 0.0),
    ("#### A", " a ", 1.0), ("#### A", "", 0.0), ("#### A", "AB", 0.0),
])
def test_qa_reward(spark, response, truth, expected):
    assert value(spark, scoring.qa_reward, response, truth) == expected


def test_evaluation_takes_first_letter_of_truth(spark):
    verdict = value(spark, lambda r, t: scoring.evaluate(r, F.lit("mmlu"), t), "#### C", "ANSWER: C")
    assert verdict is False


def test_strict_mode_rejects_unknown_domain(spark):
    with pytest.raises(Exception, match="Unknown domain"):
        value(spark, lambda r: scoring.gt_reward(F.lit("poetry"), r, r, strict=True), "#### 1")


def test_registered_reward_is_used(spark):
    scoring.register_reward("length", lambda response, truth, passed: F.length(response).cast("double"))
    try:
        assert value(spark, lambda r: scoring.gt_reward(F.lit("length"), r, r), "four") == 4.0
    finally:
        scoring._REGISTRY.pop("length")


def test_code_answer(spark):
    assert value(spark, text.code_answer, "x\n```python\ndef add(a):\n  return a\n```\ny").startswith("def add")
    assert value(spark, text.code_answer, "see def f(x): return x\n\nend") == "def f(x): return x"


def test_split_generated_placeholder(spark):
    got = value(spark, lambda t: text.split_generated(t, F.lit("math")), "<think>a</think> ")
    assert (got["think"], got["answer"]) == ("a", text.NO_ANSWER)


def test_long_texts_with_many_braces(spark):
    long = r"\boxed{" + "{a}" * 20000 + "}"
    assert value(spark, text.boxed_answer, long) == "{a}" * 20000
    assert value(spark, text.last_boxed, "x" + long) == "{a}" * 20000


@pytest.mark.parametrize("mapper, name, expected", [
    (scoring_domain, "musique", "qa"), (scoring_domain, "unseen", "math"), (memory_domain, "apps", "code"),
    (cache_domain, "mmlu_train", "qa"), (cache_domain, "unseen", "math"),
])
def test_domain_mappers(spark, mapper, name, expected):
    assert value(spark, mapper, name) == expected


def test_numina_cuts_at_first_brace(spark):
    assert value(spark, ingest.numina_answer, r"so \boxed{\frac{1}{2}}") == r"\frac{1"
