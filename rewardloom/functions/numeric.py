"""Number normalisation. A missing number is NULL, never NaN.

A normalised answer is a struct ``(num, txt)``: ``num`` where a number was read,
``txt`` otherwise. Comparing structs compares numbers as doubles and never
depends on how an engine prints them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.let import let
from rewardloom.functions.text import BOXED_SIMPLE, group, strip

# --- fixed values: patterns whose matches must equal the published ones ------
WRAPPERS = r"\\(?:text|mathrm|mathbf)\{([^}]+)\}"
FRACTION = r"\\frac\{([^}]+)\}\{([^}]+)\}"
TRAILING_UNIT = r"(?d)(dollars?|cents?|%|degrees?|°)$"
ANY_UNIT = r"(?:dollars?|cents?|\$|%|degrees?|°)"
FIRST_NUMBER = r"-?\d+(?:\.\d+)?"
LEGACY_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
HASH_NUMBER = r"####\s*(-?[\d,]+\.?\d*)"
ANY_NUMBER = r"-?[\d,]+\.?\d*"
# --- end of fixed values -----------------------------------------------------

PLAIN_NUMBER = r"^-?\d+(?:\.\d+)?\z"
FLOAT_TEXT = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"


def parse_float(text: Column) -> Column:
    """A plain decimal literal as double; anything else is null."""
    return let(strip(text), lambda bare: F.when(bare.rlike(FLOAT_TEXT), bare.try_cast("double")))


def _quotient(text: Column) -> Column:
    def divide(parts: Column) -> Column:
        top = parse_float(F.btrim(F.get(parts, 0), F.lit("()")))
        bottom = parse_float(F.btrim(F.get(parts, 1), F.lit("()")))
        return F.when(F.size(parts) == 2, let(bottom, lambda d: F.when(d != 0, top / d)))

    return F.when(F.contains(text, F.lit("/")), let(F.split(text, "/", -1), divide))


def _as_answer(text: Column) -> Column:
    def pair(plain: Column) -> Column:
        num = F.coalesce(_quotient(plain), group(plain, FIRST_NUMBER, 0).try_cast("double"))
        return let(num, lambda n: F.struct(n.alias("num"), F.when(n.isNull(), plain).alias("txt")))

    return let(text, pair)


def _unwrap(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, WRAPPERS, "$1"), FRACTION, "$1/$2")
    return F.when(
        F.contains(text, F.lit("\\")), F.replace(plain, F.lit("\\"), F.lit(""))
    ).otherwise(text)


def _unless_number(text: Column, full: Callable[[Column], Column]) -> Column:
    """Answers that are plain numbers already skip the clean-up, which keeps them."""

    def choose(t: Column) -> Column:
        done = F.struct(t.try_cast("double").alias("num"), F.lit(None).cast("string").alias("txt"))
        return F.when(t.rlike(PLAIN_NUMBER), done).otherwise(full(t))

    return let(text, choose)


def normalise(text: Column) -> Column:
    """Strict form: commas dropped, one trailing unit dropped."""

    def full(t: Column) -> Column:
        plain = strip(F.replace(_unwrap(t), F.lit("$"), F.lit("")))
        plain = F.lower(F.translate(plain, ", ", ""))
        return _as_answer(F.regexp_replace(plain, TRAILING_UNIT, ""))

    return _unless_number(text, full)


def normalise_generalization(text: Column) -> Column:
    """Units dropped anywhere, commas kept, so ``1,000`` reads as 1."""

    def full(t: Column) -> Column:
        plain = F.lower(F.replace(_unwrap(t), F.lit(" "), F.lit("")))
        return _as_answer(F.regexp_replace(plain, ANY_UNIT, ""))

    return _unless_number(text, full)


def normalise_legacy(text: Column) -> Column:
    """Lenient form, as text. Backslashes go first, so no LaTeX rule can fire."""
    plain = F.lower(F.replace(F.replace(text, F.lit("\\"), F.lit("")), F.lit(" "), F.lit("")))
    plain = F.regexp_replace(plain, ANY_UNIT, "")
    return let(plain, lambda p: F.coalesce(F.replace(group(p, LEGACY_NUMBER, 0), F.lit(","), F.lit("")), p))


def same_answer(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def numeric_answer(text: Column) -> Column:
    """Number behind ``####``, else inside ``\\boxed{}``, else the last number."""

    def read(found: Column) -> Column:
        return parse_float(F.replace(found, F.lit(","), F.lit("")))

    last = F.try_element_at(F.regexp_extract_all(text, F.lit(ANY_NUMBER), F.lit(0)), F.lit(-1))
    return F.coalesce(
        read(group(text, HASH_NUMBER)),
        read(group(text, BOXED_SIMPLE)),
        read(last),
    )


def log_scaled(number: Column) -> Column:
    """Signed log scale squeezed into [-1, 1]."""
    scaled = F.signum(number) * F.log1p(F.abs(number)) / F.lit(20.0)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scaled))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """A quotient that is ``empty`` where the denominator is zero."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty))
