"""Hard-negative mining: threshold joins over an inverted index that norm bounds keep short.

Dimensions are ordered by their share of the squared lengths. A candidate is
indexed under its leading dimensions only: what the rest can add to any score is
bounded by the norm of that suffix, and where the bound stays below the
threshold the rest is left out. Partial scores are added up dimension by
dimension, and a pair is dropped as soon as its partial score and the product of
the remaining norms cannot reach the threshold. Thresholds start high and are
lowered for those anchors whose lists are not full yet, so that most pairs are
dropped after few dimensions and every result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rewardloom.operators.ranking import first_rows
from rewardloom.session import cut_lineage

#: Candidates and anchors of one block, dimensions added up between two prunings.
CANDIDATES, ANCHORS, STEP = 2048, 512, 8
#: Shares of the greatest possible score that lists are filled from, before all rows count.
LEVELS = (0.6, 0.4, 0.2)
#: Where the search for negatives starts below a positive's score, in percent of the way down.
WAYS = (30, 100)
LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Order of the dimensions and the greatest norm: one number a dimension."""

    order: tuple[int, ...]
    longest: float


def quantised(vector: Column, scale: int) -> Column:
    """Components as whole numbers, ``floor(scale * x)``; null where one is null or not finite."""
    wide = vector.cast("array<double>")
    fit = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(fit, F.transform(wide, lambda x: F.floor(F.lit(float(scale)) * x)))


def shape_of(entries: DataFrame) -> Shape:
    squares = entries.select(F.posexplode("vector")).groupBy("pos").agg(F.sum(F.pow(F.col("col").cast("double"), 2)).alias("s"))
    order = [r.pos for r in squares.orderBy(F.desc("s"), "pos").collect()]
    long = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return Shape(tuple(order), float(np.sqrt(entries.agg(F.coalesce(F.max(long), F.lit(0.0))).head()[0])))


def _matrix(vectors: list[list[int]], shape: Shape) -> np.ndarray:
    """Rows with dimensions in order; a dimension that a row lacks is zero. In the shortest type that fits."""
    whole = np.zeros((len(vectors), len(shape.order)), np.int64)
    if shape.order:
        wide = max(shape.order) + 1
        whole = np.array([v + [0] * (wide - len(v)) for v in vectors], np.int64).reshape(-1, wide)[:, list(shape.order)]
    for kind in (np.int16, np.int32):
        if whole.size and np.iinfo(kind).min <= whole.min() and whole.max() <= np.iinfo(kind).max:
            return whole.astype(kind)
    return whole


def _unpacked(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], row[f"{name}_type"]).reshape(row[f"{name}_rows"], -1)


_CANDIDATES = [("part", "int"), ("c", "binary"), ("c_type", "string"), ("c_rows", "int"), ("c_kinds", "binary"), ("c_ids", "binary")]
_ANCHORS = [("a", "binary"), ("a_type", "string"), ("a_rows", "int"), ("a_kinds", "binary"), ("a_keys", "binary"), ("windows", "binary")]
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "long": pa.int64()}


def _schema(fields: list[tuple[str, str]]) -> tuple[pa.Schema, str]:
    return pa.schema([(n, _TYPES[t]) for n, t in fields]), ", ".join(f"{n} {t}" for n, t in fields)


def candidate_blocks(entries: DataFrame, shape: Shape, most: int, parts: int) -> DataFrame:
    """Blocks of candidates as packed arrays, dealt over ``parts``."""
    arrow, ddl = _schema(_CANDIDATES)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                rows = batch.slice(at, CANDIDATES).to_pydict()
                ids = np.full((len(rows["ids"]), most + 1), MOST, np.int64)
                for n, own in enumerate(rows["ids"]):
                    ids[n, :len(own)], ids[n, most] = own, len(own)
                matrix = _matrix(rows["vector"], shape)
                part = int(ids[:, 0].sum() % parts)
                yield pa.RecordBatch.from_pylist([{
                    "part": part, "c": matrix.tobytes(), "c_type": str(matrix.dtype), "c_rows": len(matrix),
                    "c_kinds": np.array(rows["kind"], np.int64).tobytes(), "c_ids": ids.tobytes()}], arrow)

    return entries.select("kind", "vector", "ids").mapInArrow(packed, ddl)


def anchor_blocks(anchors: DataFrame, shape: Shape, parts: int) -> DataFrame:
    """Blocks of anchors with their open windows (highest and lowest score), one copy for each part.

    ``anchors`` are (g1, g2, kind, vector, windows array<struct<high, low>>).
    """
    arrow, ddl = _schema(_ANCHORS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ANCHORS):
                rows = batch.slice(at, ANCHORS).to_pydict()
                matrix = _matrix(rows["vector"], shape)
                windows = [(n, w["high"], w["low"]) for n, own in enumerate(rows["windows"]) for w in own]
                yield pa.RecordBatch.from_pylist([{
                    "a": matrix.tobytes(), "a_type": str(matrix.dtype), "a_rows": len(matrix),
                    "a_kinds": np.array(rows["kind"], np.int64).tobytes(),
                    "a_keys": np.array([rows["g1"], rows["g2"]], np.int64).T.tobytes(),
                    "windows": np.array(windows, np.int64).tobytes()}], arrow)

    return anchors.mapInArrow(packed, ddl).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def _suffixes(matrix: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row from every ``STEP``-th dimension on; the last column is zero."""
    squares = np.add.reduceat(matrix * matrix, np.arange(0, matrix.shape[1], STEP), axis=1) if matrix.shape[1] else matrix
    left = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([left, np.zeros((len(matrix), 1))], axis=1))


def pairs_above(
    anchors: np.ndarray, candidates: np.ndarray, least: np.ndarray, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, candidate and exact score of all ``wanted`` pairs that score ``least`` of the anchor or more."""
    a, c = anchors.astype(np.float64), candidates.astype(np.float64)
    rest_a, rest_c = _suffixes(a), _suffixes(c)
    steps = rest_a.shape[1] - 1
    safe = 1e-9 * rest_a[:, :1].max(initial=0) * rest_c[:, :1].max(initial=0) + 1e-6
    floor = least.astype(np.float64) - safe
    # Index: the first steps of each candidate; beyond them no anchor of this block gets a score from it alone.
    reach = rest_c * rest_a.max(axis=0, initial=0)
    lowest = floor.min(initial=np.inf)
    short = reach < lowest if lowest > 0 else np.zeros_like(reach, bool)
    indexed = np.where(short.any(axis=1), short.argmax(axis=1), steps)
    kept = np.argsort(-indexed, kind="stable")
    kept = kept[indexed[kept] > 0] if lowest > 0 else kept
    c, rest_c, indexed, alive = c[kept], rest_c[kept], indexed[kept], wanted[:, kept].copy()
    partial = np.zeros(alive.shape)
    for step in range(steps):
        n = int(np.searchsorted(-indexed, -step, side="left"))  # candidates with more than ``step`` steps indexed
        if n == 0:
            break
        some = slice(step * STEP, (step + 1) * STEP)
        partial[:, :n] += a[:, some] @ c[:n, some].T
        alive[:, :n] &= partial[:, :n] + rest_a[:, step + 1, None] * rest_c[None, :n, step + 1] >= floor[:, None]
        if step % 2 and np.count_nonzero(alive) * 16 < alive.size:
            break
    i, j = np.nonzero(alive)
    exact = rest_a[:, 0].max(initial=0) * rest_c[:, 0].max(initial=0) < 2.0 ** 52
    scores = np.empty(len(i), np.int64)
    for at in range(0, len(i), 4096):
        own, other = i[at:at + 4096], j[at:at + 4096]
        if exact:
            scores[at:at + 4096] = np.einsum("ij,ij->i", a[own], c[other]).astype(np.int64)
        else:  # scores beyond 64 bits are cut to what a long can hold
            dots = (anchors[own].astype(object) * candidates[kept[other]].astype(object)).sum(axis=1)
            scores[at:at + 4096] = [min(max(int(x), LEAST), MOST) for x in dots]
    fit = scores >= least[i]
    return i[fit], kept[j[fit]], scores[fit]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """First ``k`` rows by falling score, then id, of candidates that stand for several ids each."""
    best = np.lexsort((ids[:, 0], -scores))[:k]
    rows = [(-int(scores[n]), int(x)) for n in best for x in ids[n, :ids[n, -1]]]
    for score, own in sorted(rows)[:k]:
        yield -score, own


def search(anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """First ``k`` rows of each open window: ``g1, g2, high, score, id``, of the anchor's label or of others.

    Every block of anchors meets every block of candidates once; a pair of blocks
    passes on at most ``k`` rows a window.
    """
    arrow, ddl = _schema([(n, "long") for n in ("g1", "g2", "high", "score", "id")])

    def met(row: dict) -> list[np.ndarray]:
        a, c = _unpacked(row, "a"), _unpacked(row, "c")
        kinds, others = np.frombuffer(row["a_kinds"], np.int64), np.frombuffer(row["c_kinds"], np.int64)
        keys = np.frombuffer(row["a_keys"], np.int64).reshape(-1, 2)
        ids = np.frombuffer(row["c_ids"], np.int64).reshape(len(others), -1)
        windows = np.frombuffer(row["windows"], np.int64).reshape(-1, 3)
        least = np.full(len(a), MOST, np.int64)
        np.minimum.at(least, windows[:, 0], windows[:, 2])
        wanted = (kinds[:, None] == others[None, :]) == same
        i, j, scores = pairs_above(a, c, least, wanted)
        begin, end = np.searchsorted(i, np.arange(len(a))), np.searchsorted(i, np.arange(len(a)), side="right")
        out = []
        for n, high, low in windows.tolist():
            own, found = scores[begin[n]:end[n]], j[begin[n]:end[n]]
            inside = (own <= high) & (own >= low)
            if inside.any():
                out += [(*keys[n].tolist(), high, s, x) for s, x in _first(own[inside], ids[found[inside]], k)]
        return out

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = np.array(met(batch.slice(at, 1).to_pylist()[0]), np.int64).reshape(-1, 5)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found.T], schema=arrow)

    hits = anchors.join(candidates, "part").drop("part").mapInArrow(searched, ddl)
    return first_rows(hits, ["g1", "g2", "high"], [F.desc("score"), F.col("id")], k)


def _lowered(
    windows: DataFrame, levels: int, at: Callable[[int], Column], find: Callable[[DataFrame], DataFrame], full: Column,
) -> DataFrame:
    """Rows of all windows: searched from the first level on, those not full again from the next level.

    ``windows`` are (g1, g2, high, ...); ``at(level)`` is the lowest score of a level,
    the last of which leaves nothing out. A later search of a window finds what the
    earlier one found and more, and takes its place.
    """
    names, done, still = ["g1", "g2", "high"], None, windows
    for level in range(levels):
        found = cut_lineage(find(still.withColumn("low", at(level))), "found")
        if level + 1 < levels:
            counts = found.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
            still = cut_lineage(still.join(counts, names, "left").filter(~F.coalesce(full, F.lit(False))).drop("n"), "open")
            found = found.join(still.select(*names), names, "left_anti")
        done = found if done is None else done.unionByName(found)
        if level + 1 < levels and still.isEmpty():
            break
    return done


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` (a condition on ``key`` and ``label``) chooses the anchors. A score is
    the inner product of the components times ``scale``, rounded down. An anchor's
    positives are the first rows of its label but its own id, by falling score, ties
    by id; the negatives of a positive are the first rows of other labels whose
    score is ``low`` to 100 percent of the positive's. All of them where there
    are fewer; none, and no row, where there is nothing.

    Rows without id or label, and vectors with a null or infinite component, take
    no part. A dimension that a vector lacks is zero. Rows alike in id, label and
    vector count once. Vectors equal under one label are compared once and stand
    for their smallest ids, as many as a list can use, so that a vector that a
    third of the table holds costs no more than another. Other columns are not read.
    An empty table gives an empty one.
    """
    plain = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), quantised(F.col(vector), scale).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor")).filter("id is not null and label is not null and vector is not null")
    hashes = [F.xxhash64(F.lit(n), "label", "vector").alias(f"g{n}") for n in (1, 2)]
    base = cut_lineage(plain.select("*", F.xxhash64("label").alias("kind"), *hashes).drop("label").distinct(), "vectors")
    most = max(positives + 1, negatives)
    entries = cut_lineage(first_rows(base, ["g1", "g2"], [F.col("id")], most).groupBy("g1", "g2").agg(
        F.first("kind").alias("kind"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    shape = shape_of(entries)
    parts = max(1, -(-entries.count() // (4 * CANDIDATES)))
    candidates = cut_lineage(candidate_blocks(entries, shape, most, parts), "candidates")

    chosen = base.filter("is_anchor").select("id", "g1", "g2")
    groups = cut_lineage(entries.join(chosen.select("g1", "g2").distinct(), ["g1", "g2"], "left_semi").select(
        "g1", "g2", "kind", "vector"), "anchors")
    few = max(1, -(-groups.count() // ANCHORS))

    def find(same: bool, k: int) -> Callable[[DataFrame], DataFrame]:
        def run(windows: DataFrame) -> DataFrame:
            own = windows.groupBy("g1", "g2").agg(F.collect_list(F.struct("high", "low")).alias("windows"))
            spread = groups.join(own, ["g1", "g2"]).repartition(few, "g1", "g2")
            return search(anchor_blocks(spread, shape, parts), candidates, same, k)
        return run

    totals = base.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    lists = cut_lineage(groups.join(totals, "kind").select(
        "g1", "g2", F.lit(MOST).alias("high"), "total", norm.alias("norm")), "lists")
    level = lambda n: (
        F.floor(F.col("norm") * (shape.longest * LEVELS[n])) if n < len(LEVELS) else F.lit(LEAST))
    best = _lowered(lists, len(LEVELS) + 1, level, find(True, positives + 1),
                    F.col("n") >= F.least(F.col("total"), F.lit(positives + 1)))

    pairs = chosen.join(best.select("g1", "g2", "score", F.col("id").alias("positive_id")), ["g1", "g2"]).filter(
        "positive_id <> id")
    pairs = cut_lineage(first_rows(pairs, ["id", "g1", "g2"], [F.desc("score"), F.col("positive_id")], positives), "positives")
    windows = cut_lineage(pairs.filter("score >= 0").select("g1", "g2", F.col("score").alias("high")).distinct(), "windows")
    hundreds = lambda x: F.call_function("div", x, F.lit(100).cast("long"))
    lowest = hundreds(F.col("high")) * low + hundreds(F.col("high") % 100 * low + 99)
    way = lambda n: F.greatest(lowest, F.col("high") - (hundreds(F.col("high") - lowest) + 1) * WAYS[n])
    found = _lowered(windows, len(WAYS), way, find(False, negatives), F.col("n") >= negatives)
    ranked = found.groupBy("g1", "g2", "high").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("falling"), F.col("id").alias("negative_id")))).alias("list"))
    joined = pairs.withColumnRenamed("score", "high").join(ranked, ["g1", "g2", "high"])
    return joined.select("id", "positive_id", "high", F.posexplode("list").alias("place", "hit")).select(
        F.col("id").alias("anchor_id"), "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.negative_id").alias("negative_id"), F.col("high").alias("positive_score"),
        (-F.col("hit.falling")).alias("negative_score"))
