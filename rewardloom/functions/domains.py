"""Data-source name -> domain, dataset and routing-key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rewardloom.schema import DATASET_DOMAIN, GT_KEY_DOMAIN

# Keyword lists and data set names, in the order in which they are tried.
SCORING_RULES = [
    ("math", ["math", "gsm"]),
    ("qa", ["mmlu", "commonsense", "obqa", "arc", "gpqa", "qa", "musique"]),
    ("code", ["humaneval", "mbpp", "code", "apps"]),
]
GT_ONLY_RULES = [
    ("math", ["math", "gsm"]),
    ("qa", ["mmlu", "commonsenseqa", "obqa", "arc_c", "arc-c", "gpqa"]),
    ("coding", ["humaneval", "mbpp", "code", "apps"]),
]
MEMORY_RULES = [
    ("math", ["gsm", "math"]),
    ("qa", ["qa", "mmlu"]),
    ("code", ["code", "humaneval", "mbpp"]),
]
ROUTE_RULES = [
    ("math", ["math", "gsm"]),
    ("qa", ["mmlu", "gpqa", "commonsenseqa", "obqa", "arc_c"]),
    ("code", ["humaneval", "mbpp", "apps"]),
]
EVAL_RULES = [
    ("math", ["gsm8k", "gsm_symbolic", "math"]),
    ("qa", ["mmlu", "commonsenseqa", "obqa", "arc_c", "arc-c", "gpqa"]),
    ("code", ["humaneval", "mbpp"]),
]
GENERALIZATION_RULES = [("math", ["numina", "math"]), ("qa", ["piqa", "siqa"])]

# Exact names of the memory mapper, a superset of the cache names.
MEMORY_EXACT = {**DATASET_DOMAIN, "humaneval": "code", "mbpp": "code", "apps": "code"}


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def by_rules(name: Column, rules: list[tuple[str, list[str]]], default: str | None) -> Column:
    """First rule with a keyword inside the lower-cased name wins."""
    low = F.lower(name)
    chain = None
    for domain, words in rules:
        hit = contains_any(low, words)
        chain = F.when(hit, F.lit(domain)) if chain is None else chain.when(hit, F.lit(domain))
    return chain.otherwise(F.lit(default))


def exact_map(name: Column, mapping: dict[str, str], default: str | None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit(default))


def scoring_domain(name: Column) -> Column:
    """Domain used when a rollout is scored; unknown names count as math."""
    return by_rules(name, SCORING_RULES, "math")


def gt_only_domain(name: Column) -> Column:
    """Domain of the ground-truth-only scorer; unknown names count as qa."""
    return by_rules(name, GT_ONLY_RULES, "qa")


def memory_domain(name: Column) -> Column:
    """Domain of a memory data set: exact names first, then keywords."""
    return F.coalesce(exact_map(name, MEMORY_EXACT, None), by_rules(name, MEMORY_RULES, "math"))


def cache_domain(name: Column) -> Column:
    """Exact names only, after dropping a ``_train`` suffix; default math."""
    return exact_map(F.regexp_replace(name, "_train$", ""), DATASET_DOMAIN, "math")


def gt_key_domain(name: Column) -> Column:
    """Domain of a key in a ground-truth id file; null means the key is dropped."""
    return exact_map(name, GT_KEY_DOMAIN, None)


def route_family(name: Column) -> Column:
    """Family whose id set is searched when routing; null never matches."""
    return by_rules(name, ROUTE_RULES, None)


def normalise_source(name: Column) -> Column:
    """``gsm_symbolic_main`` is stored under ``gsm_symbolic``."""
    return F.when(name == "gsm_symbolic_main", F.lit("gsm_symbolic")).otherwise(name)


def dataset_name(name: Column) -> Column:
    """Dataset part of a query identifier, most specific rule first."""
    low = F.lower(name)

    def has(*words: str) -> Column:
        return contains_any(low, list(words))

    plus = has("plus")
    return (
        F.when(has("gsm_symbolic"), "gsm_symbolic")
        .when(has("gsm"), "gsm8k")
        .when(has("mmlu"), "mmlu")
        .when(has("commonsenseqa"), "commonsenseqa")
        .when(has("obqa"), "obqa")
        .when(has("arc_c", "arc-c"), "arc_c")
        .when(has("gpqa"), "gpqa")
        .when(has("humaneval"), F.when(plus, "humaneval_plus").otherwise("humaneval"))
        .when(has("mbpp"), F.when(plus, "mbpp_plus").otherwise("mbpp"))
        .when(has("numina"), "numina_math")
        .when(has("siqa"), "siqa")
        .when(has("piqa"), "piqa")
        .when(has("math"), "math")
        .when(has("apps"), "apps")
        .otherwise(low)
    )


def as_identifier(value: Column) -> Column:
    """``int(float(x))`` as text where that parses, the text itself where not."""
    trimmed = F.trim(value)
    plain = trimmed.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    number = F.when(plain, trimmed.try_cast("double"))
    return F.coalesce(number.try_cast("bigint").cast("string"), value)


def query_identifier(name: Column, index: Column, problem_id: Column) -> Column:
    """Identifier inside its dataset: the index, else the problem id for code."""
    low = F.lower(name)
    whole = F.coalesce(index.try_cast("bigint").cast("string"), index)
    code = contains_any(low, ["humaneval", "mbpp", "apps"])
    return F.coalesce(whole, F.when(code, as_identifier(problem_id)))
