"""Removal of long passages that repeat across documents, over stretches of words that share a smallest run.

The stretches stand in for the compacted paths of a De Bruijn graph: they are cut
inside a text, without rows for single k-mers and joins that merge them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.words import mixed, window_hashes, word_hashes, words_of
from rewardloom.session import cut_lineage

_SEGMENT = pa.struct([("seed", pa.int64()), ("body", pa.int64()), ("first", pa.int32()), ("count", pa.int32())])
_WINDOW = pa.struct([("high", pa.int64()), ("low", pa.int64()), ("first", pa.int32())])
_RESULT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])
_RUN = "array<struct<first: int, count: int>>"


def segments_of(words: list[str], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Cuts a text's windows into stretches that share their smallest ``seed``-word run.

    Gives per stretch the hash of that run, a hash of the whole stretch with the
    run's place in it, the first window and the number of windows. Which run is
    the smallest depends on a window's words alone, so equal windows of any two
    documents always lie in stretches of the same seed.
    """
    empty = np.empty(0, np.int64)
    count = len(words) - window + 1
    if count <= 0:
        return empty, empty, empty, empty
    hashes = word_hashes(words)
    runs = window_hashes(hashes, seed)
    inside = np.lib.stride_tricks.sliding_window_view(runs, window - seed + 1)
    place = np.arange(count) + inside.argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    counts = np.diff(np.append(first, count))
    # Prefix sums as in window_hashes, for stretches of differing lengths.
    base = 0x9E3779B97F4A7C15
    steps = np.full(len(hashes), base, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes) * powers)))
    inverse = np.full(count, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    back = np.cumprod(inverse)[first]
    body = (sums[first + counts + window - 1] - sums[first]) * back
    body = mixed(body ^ mixed((place[first] - first).astype(np.uint64) * np.uint64(1 << 20) + counts.astype(np.uint64)))
    return runs[place[first]].view(np.int64), body.view(np.int64), first, counts


def _lists(kind: pa.StructType, each: list[tuple[np.ndarray, ...]]) -> pa.Array:
    """One list of structs for each tuple of equally long columns."""
    offsets = np.concatenate(([0], np.cumsum([len(x[0]) for x in each]))).astype(np.int32)
    columns = [
        pa.array(np.concatenate([x[i] for x in each]) if each else np.empty(0, np.int64)).cast(f.type)
        for i, f in enumerate(kind)
    ]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(kind)))


def _segments(window: int, seed: int) -> Callable:
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lists(_SEGMENT, [segments_of(words_of(t.as_py()), window, seed) for t in texts])

    return F.arrow_udf(cut, "array<struct<seed: bigint, body: bigint, first: int, count: int>>",
                       F.ArrowUDFType.SCALAR_ITER)


def _windows(window: int) -> Callable:
    """128-bit hashes of the windows of given stretches."""
    def list_windows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, stretches in batches:
            each = []
            for text, runs in zip(texts, stretches, strict=True):
                hashes = word_hashes(words_of(text.as_py()))
                at = np.concatenate([np.arange(r["first"], r["first"] + r["count"]) for r in runs.as_py()])
                high, low = (window_hashes(hashes, window, s)[at].view(np.int64) for s in (0, 1))
                each.append((high, low, at))
            yield _lists(_WINDOW, each)

    return F.arrow_udf(list_windows, "array<struct<high: bigint, low: bigint, first: int>>", F.ArrowUDFType.SCALAR_ITER)


def without_runs(text: str | None, runs: list[dict] | None, window: int) -> tuple[int, int, str]:
    """Words of the text, words covered by the windows of the runs, and the others joined by blanks."""
    words = words_of(text)
    covered = np.zeros(len(words) + 1, np.int64)
    for run in runs or ():
        covered[run["first"]] += 1
        covered[run["first"] + run["count"] + window - 1] -= 1
    gone = np.cumsum(covered[:-1]) > 0
    kept = [w for w, g in zip(words, gone, strict=True) if not g] if runs else words
    return len(words), len(words) - len(kept), " ".join(kept)


def _rebuilt(window: int, digest: bool) -> Callable:
    def rebuild(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, runs in batches:
            rows = [without_runs(t.as_py(), r.as_py(), window) for t, r in zip(texts, runs, strict=True)]
            texts_out = [hashlib.sha256(r[2].encode()).hexdigest() if digest else r[2] for r in rows]
            yield pa.StructArray.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array(texts_out, pa.string())], fields=list(_RESULT))

    return F.arrow_udf(rebuild, "n_words long, n_removed long, text string", F.ArrowUDFType.SCALAR_ITER)


def repeated_runs(
    documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, seed: int = 25
) -> DataFrame:
    """Windows that also start in a document of a smaller key: ``key, content, runs``.

    Edges are ``window``-word runs of the texts. Edges that share
    their smallest ``seed``-word run travel as one stretch. Where every document
    with that seed has the very same stretch, the path does not branch, and one
    smallest key holds for all its edges: it is compacted to one row. Only where
    stretches differ, at the ends of repeated passages and at edits, edges are
    listed and compared one by one, by 128-bit hashes and source coordinates.

    Seeds of one document alone, the bulk, leave after one aggregation of 16
    bytes a stretch. Aggregation merges copies before the shuffle; the joins meet
    tables with one row a seed or an edge, so that a hot passage is split by rows.
    """
    named = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null")
    named = named.withColumn("content", F.xxhash64("text"))
    stretches = cut_lineage(
        named.withColumn("s", F.explode(_segments(window, seed)(F.col("text")))).select("key", "content", "s.*"),
        "stretches")
    seeds = stretches.groupBy("seed").agg(
        F.min("key").alias("least"), F.max("key").alias("most"), F.min("body").alias("body_a"),
        F.max("body").alias("body_b")
    ).filter("least < most").select("seed", "least", (F.col("body_a") != F.col("body_b")).alias("branches"))
    # Written first, as only a join of two shuffles is split where a key is hot.
    seeds = cut_lineage(seeds, "seeds")
    shared = cut_lineage(stretches.join(seeds, "seed").filter("branches or key > least"), "shared")
    whole = shared.filter("not branches").select("key", "content", "first", "count")

    listed = shared.filter("branches").groupBy("key", "content").agg(
        F.collect_set(F.struct("first", "count")).alias("stretches"))
    edges = cut_lineage(
        named.join(listed, ["key", "content"])
        .select("key", "content", F.explode(_windows(window)(F.col("text"), F.col("stretches"))).alias("w"))
        .select("key", "content", "w.*"), "edges")
    least = edges.groupBy("high", "low").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    least = cut_lineage(least.filter("least < most").drop("most"), "least")
    single = edges.join(least, ["high", "low"]).filter("key > least").select(
        "key", "content", "first", F.lit(1).alias("count"))
    return whole.union(single).groupBy("key", "content").agg(F.collect_set(F.struct("first", "count")).alias("runs"))


def remove_repeated_spans(
    documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, seed: int = 25,
    digest: bool = False,
) -> DataFrame:
    """Documents with a struct ``spans``: n_words, n_removed and the text of the words that stay.

    A word goes if a run of ``window`` words of its document that covers it also
    starts in a document with a smaller key. All runs are judged on the input.
    With ``digest`` the struct carries the SHA-256 of the remaining text instead.

    Words are unchanged and divided by blanks and the ASCII controls 9 to 13. A
    null or empty text has no words. A passage repeated within one document alone
    stays. Rows of one key never remove from each other; each gets its own result.
    Rows with a null key take part in nothing and keep all words. Columns named
    ``spans`` are replaced, all others kept.
    """
    runs = cut_lineage(repeated_runs(documents, key, text, window, seed), "runs").select(
        F.col("key").alias("run_key"), F.col("content").alias("run_content"), F.col("runs").alias("run_list"))
    # References bound to their table, so that documents may have columns of any name.
    joined = documents.join(
        runs, (documents[key] == runs["run_key"]) & (F.xxhash64(documents[text]) == runs["run_content"]), "left")
    return joined.select(
        *[documents[c] for c in documents.columns if c != "spans"],
        _rebuilt(window, digest)(documents[text], runs["run_list"]).alias("spans"))
