"""Ground-truth rewards: one projection over rollouts, plus the reward registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.functions import numeric, text
from rewardloom.functions.domains import EVAL_RULES, GENERALIZATION_RULES, by_rules
from rewardloom.functions.let import let

RewardFunction = Callable[[Column, Column, Column], Column]


def _math_correct(response: Column, truth: Column) -> Column:
    """Null where the response holds no answer."""
    wanted = numeric.normalise(text.unwrap_ground_truth(truth))
    return let(text.math_answer(response), lambda found: F.when(
        found.isNotNull(), numeric.same_answer(numeric.normalise(found), wanted)))


def math_reward(response: Column, truth: Column) -> Column:
    """1.0 where the normalised answers agree; 0.0 where none was found."""
    return F.when(_math_correct(response, truth), 1.0).otherwise(0.0)


def qa_reward(response: Column, truth: Column) -> Column:
    """1.0 where the letters agree. The truth must be a piece of ``ABCDE``."""
    wanted = F.upper(text.strip(truth))
    valid = (wanted != "") & (F.instr(F.lit("ABCDE"), wanted) > 0)
    return F.when(valid & (text.choice_letter(response, default=None) == wanted), 1.0).otherwise(0.0)


def code_reward(passed: Column) -> Column:
    """1.0 where every recorded test passed in time; no tests score 0.0."""
    return F.when(F.coalesce(passed, F.lit(False)), 1.0).otherwise(0.0)


_REGISTRY: dict[str, RewardFunction] = {
    "math": lambda response, truth, passed: math_reward(response, truth),
    "qa": lambda response, truth, passed: qa_reward(response, truth),
    "code": lambda response, truth, passed: code_reward(passed),
    "coding": lambda response, truth, passed: code_reward(passed),
}


def register_reward(domain: str, function: RewardFunction) -> None:
    """Add or replace the reward of a domain. The function returns a Column."""
    _REGISTRY[domain] = function


def gt_reward(domain: Column, response: Column, truth: Column, passed: Column | None = None,
              strict: bool = False) -> Column:
    """Reward by domain; unknown domains score 0.0, or fail in strict mode."""
    outcome = F.lit(None).cast("boolean") if passed is None else passed
    chain = F.when(domain.isNull(), F.lit(None).cast("double")) if strict else None
    for name, function in _REGISTRY.items():
        value = function(response, truth, outcome)
        chain = F.when(domain == name, value) if chain is None else chain.when(domain == name, value)
    if strict:
        failure = F.raise_error(F.concat(F.lit("Unknown domain: "), domain)).cast("double")
        return chain.otherwise(failure)
    return chain.otherwise(0.0)


def score_gt(df: DataFrame, domain: Column, truth: Column, response: str = "response",
             passed: str | None = None) -> DataFrame:
    """Adds ``reward`` to every rollout; batch and stream share this transform."""
    outcome = F.col(passed) if passed else None
    return df.withColumn("reward", gt_reward(domain, F.col(response), truth, outcome))


def test_verdicts(outcomes: DataFrame, keys: list[str], timeout: float = 5.0) -> DataFrame:
    """One row per rollout: did every recorded test pass in time?"""
    good = F.col("passed") & (F.col("seconds") <= timeout)
    return outcomes.groupBy(*keys).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("all_passed"))


def score_code(rollouts: DataFrame, outcomes: DataFrame, keys: list[str], timeout: float = 5.0) -> DataFrame:
    verdicts = test_verdicts(outcomes, keys, timeout)
    return rollouts.join(verdicts, keys, "left").withColumn("reward", code_reward(F.col("all_passed")))


def _letter_in(truth: Column, top: str) -> Column:
    return text.group(F.upper(text.strip(truth)), f"[A-{top}]", 0)


def evaluate(response: Column, source: Column, truth: Column, passed: Column | None = None) -> Column:
    """Evaluation-time verdict; the truth letter is the first A-E found in it."""
    family = by_rules(source, EVAL_RULES, None)
    letter = text.choice_letter(response, default=None) == _letter_in(truth, "E")
    outcome = F.lit(False) if passed is None else passed
    verdict = (
        F.when(family == "math", _math_correct(response, truth))
        .when(family == "qa", letter)
        .when(family == "code", outcome)
    )
    return F.coalesce(verdict, F.lit(False))


def evaluate_generalization(response: Column, source: Column, truth: Column) -> Column:
    family = by_rules(source, GENERALIZATION_RULES, None)
    wanted = numeric.normalise_generalization(text.unwrap_ground_truth(truth))
    same = let(text.math_answer(response, later_segments=False), lambda found: F.when(
        found.isNotNull(), numeric.same_answer(numeric.normalise_generalization(found), wanted)))
    letter = text.choice_letter(response, "C", "B", None) == _letter_in(truth, "C")
    verdict = F.when(family == "math", same).when(family == "qa", letter)
    return F.coalesce(verdict, F.lit(False))
