"""Answer extraction and response splitting as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.functions.domains import EVAL_RULES, GENERALIZATION_RULES, by_rules
from rewardloom.functions.let import let

# --- fixed values: patterns whose matches must equal the published ones ------
HASH_ANSWER = r"(?d)####\s*([^#\n][^\n]*?)(?:\s*####|\s*$)"
# Possessive quantifiers match the same and never backtrack on long texts.
BOXED = r"\\boxed\{([^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+)\}"
BOXED_LAZY = r"(?d)\\boxed\{(.+?)\}"
BOXED_SIMPLE = r"\\boxed\{([^}]+)\}"
LETTER_HASH = r"####\s*([A-{hi}])\b"
LETTER_PHRASE = r"(?:THE\s+)?(?:CORRECT\s+)?ANSWER\s+IS\s*:?\s*([A-{hi}])\b"
LETTER_LAST = r"(?d)\b([A-{hi}])\b\s*$"
CODE_BLOCK = r"(?s)```python\s*(.*?)\s*```"
CODE_DEF = r"(?s)(def\s+\w+.*?)(?=\n\n|\z)"
THINK = r"(?s)<think>(.*?)</think>"
STEP = r"step:(\d+)\s"
SCORE = r"val-core/(\w+)/(?:acc|reward)/mean@1:([\d.]+)"
SMILES = r"SMILES:\s*([^\n]+)"
SEQUENCE = r"(?:Protein )?Sequence:\s*([^\n]+)"
ASSERT = r"assert\s+[^\n]+"
DOCSTRING = r'(?s)"""(.*?)"""'
NO_ANSWER = "No explicit answer provided"
# --- end of fixed values -----------------------------------------------------

WHITESPACE = " \t\n\r\x0b\x0c"
CODE_NAMES = ["apps", "humaneval", "mbpp", "code"]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_dots(text: Column) -> Column:
    return F.rtrim(text, F.lit("."))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A capture group, or null where the pattern does not match at all."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(index)), F.lit(1))


def present(text: Column) -> Column:
    """The text, or null where it is empty."""
    return let(text, lambda t: F.when(t != "", t))


def segments(text: Column, marker: str) -> Column:
    return F.split(text, marker, -1)


def _later_segment(text: Column) -> Column:
    first_lines = F.transform(
        F.slice(segments(text, "####"), 2, 1 << 30),
        lambda part: strip(F.split_part(strip(part), F.lit("\n"), F.lit(1))),
    )
    usable = F.filter(first_lines, lambda line: (line != "") & ~line.startswith("#"))
    return strip_dots(F.get(usable, 0))


def answer_after_marker(text: Column, later_segments: bool = True) -> Column:
    """Answer behind ``####``; null where there is none."""
    direct = present(strip_dots(strip(group(text, HASH_ANSWER))))
    found = F.coalesce(direct, _later_segment(text)) if later_segments else direct
    return F.when(F.contains(text, F.lit("####")), found)


def boxed_answer(text: Column) -> Column:
    """First ``\\boxed{}`` with one nested level, else up to the first brace."""
    found = F.coalesce(group(text, BOXED), group(text, BOXED_LAZY))
    return F.when(F.contains(text, F.lit("\\boxed{")), strip(found))


def math_answer(text: Column, later_segments: bool = True) -> Column:
    return F.coalesce(answer_after_marker(text, later_segments), boxed_answer(text))


def unwrap_ground_truth(truth: Column) -> Column:
    boxed = F.contains(truth, F.lit("\\boxed{"))
    return F.when(boxed, F.coalesce(group(truth, BOXED_SIMPLE), truth)).otherwise(truth)


def last_boxed(text: Column) -> Column:
    """Content of the last ``\\boxed{`` by brace depth; the whole text if none.

    The tail is cut into braces and brace-free runs, so the state machine takes
    one step per brace rather than one per character.
    """
    tail = F.element_at(segments(text, r"\\boxed\{"), -1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"))

    def step(state: Column, token: Column) -> Column:
        depth = (
            F.when(state["depth"] < 0, state["depth"])
            .when(token == "{", state["depth"] + 1)
            .when(token == "}", state["depth"] - 1)
            .otherwise(state["depth"])
        )
        size = F.when(depth < 0, state["size"]).otherwise(state["size"] + F.length(token))
        return F.struct(depth.alias("depth"), size.alias("size"))

    inside = let(tail, lambda t: F.substr(
        t, F.lit(1), F.aggregate(F.regexp_extract_all(t, F.lit(r"[{}]|[^{}]+"), F.lit(0)), start, step)["size"]))
    return F.when(F.contains(text, F.lit("\\boxed{")), inside).otherwise(text)


def choice_letter(text: Column, top: str = "E", last: str = "D", default: str | None = "X") -> Column:
    """Multiple-choice letter from a marker, a phrase, or the end of the text."""
    return let(F.upper(text), lambda upper: F.coalesce(
        group(upper, LETTER_HASH.replace("{hi}", top)),
        group(upper, LETTER_PHRASE.replace("{hi}", top)),
        group(strip(upper), LETTER_LAST.replace("{hi}", last)),
        F.lit(default),
    ))


def code_answer(text: Column) -> Column:
    """First python block, else the first function, else the whole text."""
    return strip(F.coalesce(group(text, CODE_BLOCK), group(text, CODE_DEF), text))


def extract_answer(text: Column, source: Column) -> Column:
    """Evaluation-time extractor, by source family; null where nothing is found."""
    family = by_rules(source, EVAL_RULES, None)
    return (
        F.when(family == "math", math_answer(text))
        .when(family == "qa", choice_letter(text, default=None))
        .when(family == "code", code_answer(text))
    )


def extract_answer_generalization(text: Column, source: Column) -> Column:
    family = by_rules(source, GENERALIZATION_RULES, None)
    return (
        F.when(family == "math", math_answer(text, later_segments=False))
        .when(family == "qa", choice_letter(text, top="C", last="B", default=None))
    )


def _after_think(text: Column) -> Column:
    start = F.instr(text, "</think>") + len("</think>")
    return strip(F.substr(text, start, F.length(text)))


def _has_think(text: Column) -> Column:
    return text.rlike(THINK)


def split_generated(text: Column, domain: Column) -> Column:
    """Think/answer struct of a fresh response: tags, code block, marker, halves."""
    half = F.floor(F.length(text) / 2).cast("int")
    is_code = domain.isin(CODE_NAMES)

    def at_marker(marker: str) -> Column:
        parts = segments(text, marker)
        return F.struct(
            strip(F.get(parts, 0)).alias("think"),
            F.concat(F.lit(marker), F.get(parts, 1)).alias("answer"),
        )

    tagged = F.struct(
        strip(F.regexp_extract(text, THINK, 1)).alias("think"),
        F.coalesce(present(_after_think(text)), F.lit(NO_ANSWER)).alias("answer"),
    )
    halves = F.struct(
        F.substr(text, F.lit(1), half).alias("think"),
        F.substr(text, half + 1, F.length(text)).alias("answer"),
    )
    return (
        F.when(_has_think(text), tagged)
        .when(is_code & F.contains(text, F.lit("```python")), at_marker("```python"))
        .when(~is_code & F.contains(text, F.lit("####")), at_marker("####"))
        .otherwise(halves)
    )


def split_scored(text: Column, answer_chars: int | None = None) -> Column:
    """Think/answer struct used when scoring: at the marker, else the whole text for both.

    ``answer_chars`` limits the answer of an unmarked response for an encoder that
    takes short inputs; by default nothing is cut.
    """
    parts = segments(text, "####")
    marked = F.struct(strip(F.get(parts, 0)).alias("think"), strip(F.get(parts, 1)).alias("answer"))
    answer = text if answer_chars is None else F.substr(text, F.lit(1), F.lit(answer_chars))
    plain = F.struct(text.alias("think"), answer.alias("answer"))
    return F.when(F.contains(text, F.lit("####")), marked).otherwise(plain)


def split_tagged(text: Column) -> Column:
    """Think/answer struct from tags only; without tags all of it is answer."""
    tagged = F.struct(
        strip(F.regexp_extract(text, THINK, 1)).alias("think"), _after_think(text).alias("answer")
    )
    plain = F.struct(F.lit("").alias("think"), text.alias("answer"))
    return F.when(_has_think(text), tagged).otherwise(plain)


def tagged_answer(text: Column) -> Column:
    """Text between answer tags, else behind ``####`` (trailing dots kept)."""
    start = F.instr(text, "<answer>") + len("<answer>")
    end = F.instr(text, "</answer>")
    has_tags = (F.instr(text, "<answer>") > 0) & (end > 0)
    inside = strip(F.substr(text, start, F.greatest(end - start, F.lit(0))))
    direct = group(text, HASH_ANSWER)
    lines = F.transform(
        F.slice(segments(text, "####"), 2, 1 << 30),
        lambda part: strip(F.split_part(strip(part), F.lit("\n"), F.lit(1))),
    )
    later = F.get(F.filter(lines, lambda line: (line != "") & ~line.startswith("#")), 0)
    marked = F.when(F.contains(text, F.lit("####")), F.coalesce(strip(direct), later))
    return F.when(has_tags, inside).otherwise(marked)


def core_text(text: Column) -> Column:
    """``SMILES:`` and ``Sequence:`` lines joined by a bar, else the whole text."""
    parts = F.concat_ws(
        " | ",
        F.concat(F.lit("SMILES: "), group(text, SMILES)),
        F.concat(F.lit("Sequence: "), group(text, SEQUENCE)),
    )
    return F.coalesce(present(parts), text)


def log_step(line: Column) -> Column:
    return group(line, STEP).cast("bigint")


def log_scores(line: Column) -> Column:
    """Array of ``(dataset, score)`` structs named in one log line."""
    return F.zip_with(
        F.regexp_extract_all(line, F.lit(SCORE), F.lit(1)),
        F.regexp_extract_all(line, F.lit(SCORE), F.lit(2)),
        lambda name, score: F.struct(name.alias("dataset"), score.try_cast("double").alias("score")),
    )


def brace_balance(text: Column) -> Column:
    """Opening minus closing braces."""
    return F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))
