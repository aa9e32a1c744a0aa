"""URL filters: host and path rules, then a ratio of two character language models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_EDGE = 0x110000  # beyond every code point: stands before and after a URL


@dataclass(frozen=True)
class Rule:
    """``host/path`` prefix; holds for the host, its subdomains and paths that start so."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path with its leading slash; both empty without ``://``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (name, verdict) of the longest rule that fits, else null; equal lengths go by name."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        mine = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(rule.fits(host, path), mine).otherwise(found)
    return found


def _points(url: str, order: int) -> np.ndarray:
    """Code points of a URL without scheme, after ``order`` edge marks and before one."""
    body = url.split("://", 1)[-1].lower()
    inner = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = np.full(order, _EDGE, np.uint64)
    return np.concatenate((edge, inner, edge[:1]))


def gram_slots(url: str, order: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of contexts and of contexts with their next character: rows are lengths 0 to ``order``."""
    points = _points(url, order)
    at = np.arange(order, len(points))
    context = np.zeros(len(at), np.uint64)
    contexts, grams = [], []
    for length in range(order + 1):
        if length:
            # The context grows to the left; its hash depends on every character and its distance.
            context = (context ^ (points[at - length] + np.uint64(length << 32))) * np.uint64(0x9E3779B97F4A7C15)
            context ^= context >> np.uint64(32)
        gram = (context ^ (points[at] + np.uint64(77 << 40))) * np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(29)
        seen = context * np.uint64(0xBF58476D1CE4E5B9)
        contexts.append((seen ^ (seen >> np.uint64(31))) % np.uint64(slots))
        grams.append(gram % np.uint64(slots))
    return np.stack(contexts).astype(np.int64), np.stack(grams).astype(np.int64)


@dataclass(frozen=True)
class UrlModels:
    """Counts of the two variable-order models in hashed tables (accepted, rejected), and the limit."""

    contexts: np.ndarray  # 2 x slots
    grams: np.ndarray     # 2 x slots
    order: int
    strength: float
    limit: float = 0.0

    def ratio(self, url: str) -> float:
        """Log-likelihood of the accepted over the rejected model, for each character.

        A context of length n mixes its own counts with ``strength`` times the
        estimate of length n - 1; at the bottom stands a uniform distribution.
        Contexts not seen leave the shorter one's estimate as it is, so the order
        used varies with the evidence.
        """
        contexts, grams = gram_slots(url, self.order, self.grams.shape[1])
        total = 0.0
        for sign, seen, told in ((1, self.contexts[0], self.grams[0]), (-1, self.contexts[1], self.grams[1])):
            chance = np.full(contexts.shape[1], 1 / 256)
            for length in range(self.order + 1):
                many = np.minimum(told[grams[length]], seen[contexts[length]])
                chance = (many + self.strength * chance) / (seen[contexts[length]] + self.strength)
            total += sign * np.log(chance).mean()
        return float(total)


def _counted(order: int, slots: int) -> Callable:
    """Slots met in labelled URLs with their counts, merged within a batch."""
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [[], [], [], []]
            for url, good in zip(batch.column("url"), batch.column("good"), strict=True):
                contexts, grams = gram_slots(url.as_py(), order, slots)
                side = 0 if good.as_py() else 1
                met[side].append(contexts.ravel())
                met[2 + side].append(grams.ravel())
            for kind, parts in enumerate(met):
                if parts:
                    slot, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), kind), pa.int32()), pa.array(slot), pa.array(n)], schema=schema)

    return count


def _scored(sent: object) -> Callable:
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        models = UrlModels(*sent.value)
        for urls in batches:
            yield pa.array([models.ratio(u) if (u := v.as_py()) else None for v in urls], pa.float64())

    return F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)


def url_scores(pages: DataFrame, models: UrlModels, url: str = "url", out: str = "score") -> DataFrame:
    """Pages with the length-normalised log-likelihood difference; null for a null or empty URL."""
    sent = pages.sparkSession.sparkContext.broadcast((models.contexts, models.grams, models.order, models.strength))
    return pages.withColumn(out, _scored(sent)(F.col(url)))


def fit_url_models(
    labelled: DataFrame, url: str = "url", good: str = "good", order: int = 5, slots: int = 1 << 18,
    strength: float = 4.0, lost: float = 0.005,
) -> UrlModels:
    """Two smoothed variable-order Markov models of all labelled URLs, with a calibrated limit.

    Counts cover every labelled URL; they are summed on the cluster into tables of
    ``slots`` places a model, which bounds what is collected and broadcast. One URL
    in five, by a hash of its text, is kept from the counts and sets the limit: the
    highest at which at most ``lost`` of the accepted of them are blocked, but not
    above the middle of the two classes. Null URLs and labels teach nothing; with
    one class alone the limit blocks nothing.
    """
    rows = labelled.select(F.col(url).alias("url"), F.col(good).alias("good")).filter(
        "url is not null and url <> '' and good is not null")
    apart = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counted = rows.filter(~apart).mapInArrow(_counted(order, slots), "kind int, slot long, n long")
    sums = counted.groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((4, slots))
    tables[sums["kind"].to_numpy(), sums["slot"].to_numpy()] = sums["n"].to_numpy()
    models = UrlModels(tables[:2], tables[2:], order, strength)
    # A histogram in steps of 1/64 holds what calibration needs, however many rows there are.
    step = 64
    bins = url_scores(rows.filter(apart), models).groupBy(
        "good", F.floor(F.greatest(F.lit(-64), F.least(F.lit(64), "score")) * step).alias("bin")).count().toPandas()
    limit = calibrated_limit(bins[bins["good"]], bins[~bins["good"].astype(bool)], lost) / step
    return UrlModels(tables[:2], tables[2:], order, strength, limit)


def calibrated_limit(good: object, bad: object, lost: float) -> float:
    """The bin below which URLs are blocked."""
    if not len(good) or not len(bad):
        return -float("inf")
    good = good.sort_values("bin")
    below = good["count"].cumsum() - good["count"]
    most = good["bin"][below <= lost * good["count"].sum()].max()
    middle = (np.average(good["bin"], weights=good["count"]) + np.average(bad["bin"], weights=bad["count"])) / 2
    return float(min(most, np.ceil(middle)))


def judged_urls(pages: DataFrame, rules: list[Rule], models: UrlModels, url: str = "url") -> DataFrame:
    """Pages with ``host``, ``path``, ``rule``, ``score`` and ``verdict``.

    The longest rule that fits decides; without one the models do: a score below
    the limit blocks. A null or empty URL, which no model can read, is blocked.
    Repeated rows are judged each; columns of these names are replaced.
    """
    host, path = host_and_path(F.col(url))
    scored = url_scores(pages, models, url).withColumns({"host": host, "path": path})
    fits = longest_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.col("score") >= models.limit, ALLOW).otherwise(BLOCK)
    return scored.withColumns({"rule": fits["name"], "verdict": F.coalesce(fits["verdict"], method)})
