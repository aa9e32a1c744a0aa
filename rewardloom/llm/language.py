"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
MOST_LANGUAGES = 1024  # classes of a model; the driver trains and holds buckets times languages numbers
_RUN = re.compile(r"[^\W\d_]+")  # runs of letters, and of numbers that are no decimal digits


def has_letter(text: str | None) -> bool:
    return bool(text) and any(any(map(str.isalpha, run.group())) for run in _RUN.finditer(text))


def subword_rows(text: str, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of a whole text's subwords and how often each occurs.

    Subwords are runs of 1 to ``longest`` code points of the lower-cased text, with
    one blank on either side of every word; runs across a word's end are left out.
    """
    points = np.frombuffer((" " + " ".join(_RUN.findall(text.lower())) + " ").encode("utf-32-le"), np.uint32)
    blank = points == 32
    found = []
    rolled = np.zeros(len(points), np.uint64)
    for size in range(1, longest + 1):
        count = len(points) - size + 1
        if count <= 0:
            break
        rolled = (rolled[:count] * np.uint64(0x9E3779B97F4A7C15)) + points[size - 1:].astype(np.uint64) + np.uint64(1)
        inner = np.ones(count, bool)
        for i in range(1, size - 1):
            inner &= ~blank[i:i + count]
        if size == 1:
            inner = ~blank
        spread = (rolled[inner] ^ (rolled[inner] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((spread >> np.uint64(32)) % np.uint64(buckets))
    rows, counts = np.unique(np.concatenate(found).astype(np.int64), return_counts=True)
    return rows, counts


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the score of each embedding row for each language, and what calibration found."""

    languages: tuple[str, ...]
    scores: np.ndarray       # embeddings times softmax weights: buckets x languages
    bias: np.ndarray
    sharpness: float         # logits are multiplied by this before the softmax
    least_confidence: float  # below it a prediction is rejected
    longest: int

    def probabilities(self, text: str) -> np.ndarray:
        rows, counts = subword_rows(text, len(self.scores), self.longest)
        logits = (counts @ self.scores[rows] / counts.sum() + self.bias) * self.sharpness
        return _softmax(logits[None])[0]


def _softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


def train(
    texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: tuple[str, ...], held: np.ndarray,
    buckets: int, longest: int, width: int = 16, steps: int = 16000, rate: float = 0.5, precision: float = 0.99,
    seed: int = 7,
) -> LanguageModel:
    """Stochastic gradient descent on single texts, about ``steps`` of them; ``held`` rows calibrate.

    A text is the mean of its subwords' embeddings. On held rows the sharpness is
    chosen that makes the true languages most likely, then the smallest confidence
    from which on the accepted predictions are right at the given ``precision``.
    Targets are a little below one (Platt), so that few rows never make it certain.
    """
    random = np.random.default_rng(seed)
    embed = random.uniform(-1, 1, (buckets, width)).astype(np.float32) / width
    weights = np.zeros((width, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    learn = np.flatnonzero(~held)
    epochs, step = -(-steps // max(len(learn), 1)), 0
    for _ in range(epochs):
        for i in random.permutation(learn):
            rows, counts = texts[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ embed[rows]
            error = _softmax((mean @ weights + bias)[None])[0]
            error[labels[i]] -= 1
            now = rate * (1 - step / (epochs * len(learn)))
            back = weights @ error
            weights -= now * np.outer(mean, error)
            bias -= now * 0.1 * error
            # A subword moves with the root of its share, else rare ones would hardly learn from long texts.
            embed[rows] -= (now * np.sqrt(share))[:, None] * back[None, :]
            step += 1
    scores = embed @ weights
    checked = np.flatnonzero(held)
    if not len(checked):
        return LanguageModel(languages, scores, bias, 1.0, 0.0, longest)
    logits = np.stack([c @ scores[r] / c.sum() + bias for r, c in (texts[i] for i in checked)])
    true = labels[checked]
    doubt = 1 / (len(true) + 2)
    target = np.full(logits.shape, doubt / max(len(languages) - 1, 1))
    target[np.arange(len(true)), true] = 1 - doubt
    likely = lambda s: -(target * np.log(_softmax(logits * s) + 1e-300)).sum()
    sharpness = min(np.geomspace(0.25, 64, 60), key=likely)
    chances = _softmax(logits * sharpness)
    sure, right = chances.max(axis=1), chances.argmax(axis=1) == true
    order = np.argsort(-sure, kind="stable")
    good = np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1)
    least = float(sure[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return LanguageModel(languages, scores, bias, float(sharpness), least, longest)


def training_rows(documents: DataFrame, key: str, text: str, lang: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts of each language, drawn by a hash of key and text.

    Languages are counted over all rows first; the draw thins each by its share where
    the text is read, and the ranking that fixes the bound meets few rows of any
    language. The shares are one number for each class of the model.
    """
    known = documents.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit("draw"), key, text).alias("draw"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = [F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * rows / r["n"]))]
    share = F.element_at(F.create_map(*shares), F.col("lang")) if shares else F.lit(0.0)
    drawn = known.filter(F.pmod("draw", F.lit(1 << 30)) < share * float(1 << 30))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text")))
    return ranked.filter(F.col("rank") <= rows).select("text", "lang", "draw")


def fit_languages(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 500,
    buckets: int = 1 << 15, longest: int = 4, **options: float,
) -> LanguageModel:
    """Trains on a bounded sample: ``rows`` texts of each language at most, whole, as subword counts.

    The driver receives no texts; a text is at most ``buckets`` pairs of numbers.
    More than ``MOST_LANGUAGES`` languages raise a ValueError.
    Only ``text`` and ``lang`` teach; ``key`` only draws the sample. Rows without a
    language or a letter are not used. A table without labels gives a model that
    knows no language.
    """
    kind = pa.struct([("rows", pa.binary()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            each = [subword_rows(t.as_py(), buckets, longest) for t in texts]
            packed = [[x.astype(np.int32).tobytes() for x in pair] for pair in each]
            yield pa.array([{"rows": r, "counts": c} for r, c in packed], kind)

    counted = F.arrow_udf(count, "rows binary, counts binary", F.ArrowUDFType.SCALAR_ITER)
    sample = training_rows(documents, key, text, lang, rows).withColumn("s", counted(F.col("text")))
    found = sample.select("lang", "draw", "s.rows", "s.counts").orderBy("lang", "draw").toPandas()
    found = found[found["rows"].map(len) > 0]
    languages = tuple(sorted(found["lang"].unique()))
    if not languages:
        return LanguageModel((), np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, longest)
    labels = np.searchsorted(np.array(languages, dtype=object), found["lang"].to_numpy())
    held = ((found["draw"].to_numpy() >> 32) % 5 == 0)
    texts = [tuple(np.frombuffer(bytes(x), np.int32) for x in pair)
             for pair in zip(found["rows"], found["counts"], strict=True)]
    return train(texts, labels, languages, held, buckets, longest, **options)


def _predicted(model: object) -> Callable:
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = LanguageModel(*model.value)
        for texts in batches:
            rows = []
            for value in texts:
                text = value.as_py()
                if not known.languages or not has_letter(text):
                    rows.append({"lang": UNDETERMINED, "score": 0.0, "accepted": False})
                    continue
                chances = known.probabilities(text)
                best = int(chances.argmax())
                rows.append({"lang": known.languages[best], "score": float(chances[best]),
                             "accepted": bool(chances[best] >= known.least_confidence)})
            yield pa.array(rows, kind)

    return F.arrow_udf(predict, "lang string, score double, accepted boolean", F.ArrowUDFType.SCALAR_ITER)


def identified(documents: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """Documents with a struct ``out``: lang, score (calibrated, 0 to 1), accepted.

    ``lang`` is the likeliest learned language of the whole text, or ``und`` (score
    0) for a null text or one without a letter. ``accepted`` is false where the
    score is below the calibrated confidence; a caller that wants rejection treats
    such rows as undetermined. The model is ``buckets`` times languages numbers and
    is sent to the workers once. A column named ``out`` is replaced.
    """
    sent = documents.sparkSession.sparkContext.broadcast((
        model.languages, model.scores, model.bias, model.sharpness, model.least_confidence, model.longest))
    return documents.withColumn(out, _predicted(sent)(F.col(text)))
