"""Quality rules: a decision list learned from labelled text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.words import words_of

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_digits", "n_marks",
]
# Counts over counts that do not drift with the length of a text, so that no rule
# takes a long clean text for a bad one (the share of distinct words would).
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"), "digit_share": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}
FEATURES = list(RATIOS)


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    text = text or ""
    words = words_of(text)
    total = len(words)
    repeated = 0
    if total > 2:
        triples = list(zip(words, words[1:], words[2:], strict=False))
        often = Counter(triples)
        if len(often) < len(triples):
            covered = np.zeros(total + 1, np.int64)
            starts = np.flatnonzero(np.fromiter((often[t] > 1 for t in triples), bool, len(triples)))
            np.add.at(covered, starts, 1)
            np.add.at(covered, np.minimum(starts + 3, total), -1)
            repeated = int((np.cumsum(covered[:total]) > 0).sum())
    lines = [line for line in text.split("\n") if words_of(line)] if "\n" in text else [text] * bool(total)
    ascii_only = text.isascii()
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if ascii_only else sum(map(str.isupper, text))
    digits = sum(map(text.count, "0123456789"))
    letters = sum(map(str.isalpha, text))
    return (
        total, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), upper, letters, digits, sum(map(text.count, "!?")),
    )


_ARROW = pa.struct([(name, pa.int64()) for name in COUNTS])


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        columns = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS)).T
        yield pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_ARROW))


def text_statistics(documents: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Documents with a struct of whole-text counts and the ratios of ``RATIOS``."""
    count = F.arrow_udf(_counted, ", ".join(f"{n} long" for n in COUNTS), F.ArrowUDFType.SCALAR_ITER)
    with_counts = documents.withColumn(out, count(F.col(text)))
    of = lambda name: F.col(f"{out}.{name}")
    ratios = [F.coalesce(of(a) / F.nullif(of(b), F.lit(0)), F.lit(0.0)).alias(n) for n, (a, b) in RATIOS.items()]
    return with_counts.withColumn(out, F.struct(*[of(n).alias(n) for n in COUNTS], *ratios))


@dataclass(frozen=True)
class Condition:
    """``feature <= limit`` or ``feature > limit``."""

    feature: str
    above: bool
    limit: float

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.feature}")
        return value > self.limit if self.above else value <= self.limit

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.limit if self.above else rows[self.feature] <= self.limit


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject; a text that meets none is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self, stats: str = "stats") -> Column:
        """Number of the first rule that a row meets, from 1; null where none does."""
        chain = None
        for number, rule in enumerate(self.rules, 1):
            met = reduce(Column.__and__, [c.column(stats) for c in rule])
            chain = F.when(met, number) if chain is None else chain.when(met, number)
        return F.lit(None).cast("int") if chain is None else chain

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.limit:g}" for c in r) for r in self.rules]


def _met(rule: list[Condition], rows: dict[str, np.ndarray], count: int) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(rows) for c in rule], np.ones(count, bool))


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, longest: int, limits: int) -> list[Condition]:
    """Adds the condition of the greatest information gain until no good row is covered."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < longest and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for feature, values in rows.items():
            cuts = np.unique(np.quantile(values[inside], np.linspace(0, 1, limits + 1)))
            for limit in (cuts[:-1] + cuts[1:]) / 2:
                over = values > limit
                for above in (True, False):
                    met = inside & (over if above else ~over)
                    hit = (met & bad).sum()
                    if hit and (g := hit * (np.log2(hit / met.sum()) - np.log2(p / n))) > gain:
                        best, gain = Condition(feature, above, float(limit)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(rows)
    return rule


def _prune(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[list[Condition], float, int]:
    """The leading part of a rule with the best precision on rows that it was not grown on."""
    best = (rule, -1.0, 0)
    for size in range(1, len(rule) + 1):
        met = _met(rule[:size], rows, len(bad))
        p, n = int((met & bad).sum()), int(met.sum())
        worth = (p + 1) / (n + 2)
        if worth > best[1]:
            best = (rule[:size], worth, n)
    return best


def _by_chance(p: int, n: int, share: float) -> float:
    """Chernoff's bound on the probability that ``p`` or more of ``n`` rows are bad, each with probability ``share``."""
    found = p / n
    if found <= share:
        return 1.0
    away = found * log(found / share) + ((1 - found) * log((1 - found) / (1 - share)) if found < 1 else 0.0)
    return exp(-n * away)


def learn_decision_list(
    rows: dict[str, np.ndarray], bad: np.ndarray, folds: np.ndarray, precision: float = 0.9, longest: int = 4,
    most: int = 16, limits: int = 64, chance: float = 0.001,
) -> DecisionList:
    """Sequential covering: grow rules on two thirds of the rows, prune each on the other third, take the best.

    Each of the three ``folds`` (0 to 2) prunes once, so that every row is judged by a
    rule grown without it. A rule joins the list if of the rows so covered the share
    ``precision`` is bad and chance alone would hardly (``chance``) pick so many bad
    ones at the share that is left. Six rejected rows with a clean gap are enough;
    shuffled labels give no rule. Of the three rules the one that holds best on all
    rows is taken, and what it covers is taken away.
    """
    rules, left = [], np.ones(len(bad), bool)
    while len(rules) < most and (left & bad).any():
        p = n = 0
        grown: list[tuple[float, int, tuple[Condition, ...]]] = []
        for fold in range(3):
            seen, checked = left & (folds != fold), left & (folds == fold)
            rule = _grow({k: v[seen] for k, v in rows.items()}, bad[seen], longest, limits) if (seen & bad).any() else []
            if not rule:
                continue
            rule = _prune(rule, {k: v[checked] for k, v in rows.items()}, bad[checked])[0]
            met = _met(rule, rows, len(bad))
            p, n = p + int((met & checked & bad).sum()), n + int((met & checked).sum())
            hit, all_met = int((met & left & bad).sum()), int((met & left).sum())
            grown.append(((hit + 1) / (all_met + 2), -len(rule), tuple(rule)))
        if not n or p < precision * n or _by_chance(p, n, float(bad[left].mean())) > chance:
            break
        best = max(grown, key=lambda g: g[:2])[2]
        rules.append(best)
        left &= ~_met(list(best), rows, len(bad))
    return DecisionList(tuple(rules))


def labelled_sample(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """About ``rows`` labelled ids, chosen by a hash of the id; all of them where there are fewer.

    Ids whose labels contradict one another are left out, as no rule can fit both.
    """
    each = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(
        F.min(label).alias("label"), F.max(label).alias("other"))
    each = each.filter("label = other").select(key, "label", F.xxhash64(F.lit("sample"), key).alias("draw"))
    total = each.count()
    share = min(1.0, rows / max(total, 1))
    return each.filter(F.pmod("draw", F.lit(1 << 20)) < share * (1 << 20))


def fit_quality_rules(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = 20000, **options: float,
) -> DecisionList:
    """Learns rules that reject texts labelled 0, from a bounded sample of labelled rows.

    ``sample_rows`` bounds the rows that reach the driver (eight numbers each, no
    texts), one for each labelled id: that of the least features. Rows without a label, with a null label or a null text teach nothing;
    without both kinds of labels there are no rules.
    """
    drawn = labelled_sample(labels, key, label, sample_rows).withColumnRenamed(key, "labelled_key")
    known = documents.select(F.col(key).alias("labelled_key"), F.col(text).alias("labelled_text")).filter(
        F.col("labelled_text").isNotNull()).join(F.broadcast(drawn), "labelled_key")
    features = F.struct(*[F.col(f"stats.{f}").cast("double").alias(f) for f in FEATURES])
    rows = text_statistics(known, "labelled_text").groupBy("labelled_key", "label", "draw").agg(
        F.min(features).alias("least")).select("labelled_key", "label", "draw", "least.*").toPandas().sort_values("labelled_key")
    bad = rows["label"].to_numpy() == 0
    if bad.all() or not bad.any():
        return DecisionList(())
    folds = (rows["draw"].to_numpy() >> 20) % 3
    return learn_decision_list({f: rows[f].to_numpy() for f in FEATURES}, bad, folds, **options)


def base_failed(stats: str = "stats", least_words: int = 50, repeat_percent: int = 50) -> Column:
    """Too few words, or more than half of them inside repeated three-word windows."""
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < least_words) | (100 * repeated > repeat_percent * words)


def judged_quality(documents: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Documents with ``stats``, ``base_failed``, ``rule`` (first rule met) and ``kept`` beside their columns.

    A null text counts as an empty one and fails the base rules. Rows are judged
    each on their own; columns of these names are replaced, others kept.
    """
    judged = text_statistics(documents, text)
    return (
        judged.withColumn("base_failed", base_failed())
        .withColumn("rule", rules.rejects())
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
