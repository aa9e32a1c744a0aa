"""Near-duplicate join on word shingles: chosen paths find candidates, exact Jaccard decides."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.components import connected_components
from rewardloom.llm.words import mixed, window_hashes, word_hashes, words_of
from rewardloom.session import cut_lineage

COORDINATES = 128  # MinHash values of a sketch; a similarity estimate errs by 0.035 at 0.8
SHALLOW = 3  # depth for which all sets get runs; sets split past it get more
_FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLACES = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles_of(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; a shorter text is one run."""
    words = words_of(text)
    return np.unique(window_hashes(word_hashes(words), min(size, len(words)))) if words else np.empty(0, np.uint64)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 2048):
        spread = (shingles[i:i + 2048, None] * _FACTORS) >> np.uint64(32)
        least = np.minimum(least, spread.min(axis=0).astype(np.uint32))
    return least


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of the whole set."""
    return tuple(int(mixed(shingles ^ np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (0, 0xA5A5A5A5A5A5A5A5))


_SKETCH = pa.struct([("high", pa.int64()), ("low", pa.int64()), ("size", pa.int64()), ("sketch", pa.binary())])


def _sketched(size: int) -> Callable:
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts:
                shingles = shingles_of(text.as_py(), size)
                high, low = digests(shingles)
                rows.append({"high": high, "low": low, "size": len(shingles), "sketch": sketch_of(shingles).tobytes()})
            yield pa.array(rows, _SKETCH)

    return F.arrow_udf(sketch, "high long, low long, size long, sketch binary", F.ArrowUDFType.SCALAR_ITER)


def _shingled(size: int) -> Callable:
    """Sets of chosen texts. The id is passed so that the work stays behind the join that chooses."""
    kind = pa.struct([("high", pa.int64()), ("low", pa.int64()), ("shingles", pa.binary())])

    def shingle(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, _ in batches:
            sets = [shingles_of(t.as_py(), size) for t in texts]
            yield pa.array([dict(zip(kind.names, (*digests(s), s.tobytes()), strict=True)) for s in sets], kind)

    return F.arrow_udf(shingle, "high long, low long, shingles binary", F.ArrowUDFType.SCALAR_ITER)


def _children(similarity: float) -> Callable:
    """Buckets of the next level: a path samples about 1/similarity coordinates, and each splits by value.

    The choice depends on the path alone, so documents that share the values of the
    sampled coordinates take the same paths.
    """
    chosen = np.uint64(int(2.0**64 / (similarity * COORDINATES)))

    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, sketches in batches:
            out = []
            for own, sketch in zip(paths, sketches, strict=True):
                own = np.array(own.as_py(), np.int64).view(np.uint64)
                values = np.frombuffer(sketch.as_py(), np.uint32).astype(np.uint64)
                which, place = np.nonzero(mixed(own[:, None] ^ _PLACES[None, :]) < chosen)
                out.append(mixed(mixed(own[which] + _PLACES[place]) ^ values[place]).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(o) for o in out]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else [], pa.int64()))

    return F.arrow_udf(split, "array<bigint>", F.ArrowUDFType.SCALAR_ITER)


def _agreement(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Share of equal coordinates of two sketches."""
    for left, right in batches:
        yield pa.array([
            float((np.frombuffer(a.as_py(), np.uint32) == np.frombuffer(b.as_py(), np.uint32)).mean())
            for a, b in zip(left, right, strict=True)], pa.float64())


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches; a run is bounded by the caller."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not rows.num_rows:
            continue
        columns = [rows.column(k).to_numpy() for k in keys]
        changes = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
        cuts = np.concatenate(([0], np.flatnonzero(changes) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield rows.slice(a, b - a)
        rest = rows.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _reached(count: int, linked: Callable[[int], np.ndarray]) -> np.ndarray:
    """Component of each of ``count`` rows; ``linked(i)`` masks the rows linked to row i.

    A row is expanded only while rows without a component remain, so a bucket of
    rows that are all alike costs a few comparisons a row.
    """
    root = np.full(count, -1)
    for start in range(count):
        if root[start] >= 0:
            continue
        root[start], queue = start, [start]
        while queue and (root < 0).any():
            fresh = np.flatnonzero(linked(queue.pop()) & (root < 0))
            root[fresh] = start
            queue.extend(fresh.tolist())
    return root


def _bucket_edges(least: float, keys: list[str]) -> Callable:
    """Edges from each row of a bucket (rows of equal ``keys``) to the smallest id of its component.

    A group of near copies meets in many buckets; its smallest id is in most of
    them, so that most edges are the same ones.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for rows in _groups(batches, keys):
            rows = rows.sort_by("id")
            ids = rows.column("id").to_numpy()
            sketches = np.stack([np.frombuffer(s.as_py(), np.uint32) for s in rows.column("sketch")])
            root = _reached(len(ids), lambda i, s=sketches: (s == s[i]).mean(axis=1) >= least)
            away = np.flatnonzero(root != np.arange(len(ids)))
            left.extend(ids[away].tolist())
            right.extend(ids[root[away]].tolist())
            if len(left) > 50000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    return connect


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    count = len(sets)
    if count == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float32)
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(count), [len(s) for s in sets])
    # Shingles of one set alone meet no other set.
    use = often[column] > 1
    number = np.cumsum(often > 1) - 1
    rows, column = rows[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = 4096
    total = np.zeros((count, count), np.float32)
    for first in range(0, int((often > 1).sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        piece = np.zeros((count, width), np.float32)
        piece[rows[a:b], column[a:b] - first] = 1
        total += piece @ piece.T
    return total


def _verified(similarity: float) -> Callable:
    """Exact links of each group: copies linked to every row, and the first row it is connected to."""
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["component", "one", "two"]):
            rows = rows.sort_by("id")
            ids, copies, block = (rows.column(c).to_numpy() for c in ("id", "copies", "block"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
            sizes = np.array([len(s) for s in sets], np.float64)
            common = shared_counts(sets).astype(np.float64)
            # J >= s, written without a division.
            link = common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-9
            np.fill_diagonal(link, False)
            if rows.column("one")[0].as_py() != rows.column("two")[0].as_py():
                link &= block[:, None] != block[None, :]  # pairs inside a block have a group of their own
            root = _reached(len(ids), lambda i, m=link: m[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(link @ copies), pa.array(ids[root])], schema=schema)

    return verify


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs after which a pair of just ``similarity`` has shared a bucket of ``depth`` with chance ``recall``.

    At that similarity a path keeps one common child on average; the chance that a
    line of paths survives follows from the branching process.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


def lost_share(similarity: float, depth: int, runs: int, more: int = 0) -> float:
    """Share of pairs of just ``similarity`` that meet in no bucket, if buckets are split down to ``depth``.

    ``more`` runs start from the sets split past SHALLOW; a pair that has shared no
    bucket so deep need not be among them. Sketches agree in a binomial number of
    coordinates, and all runs see the same sketches, so the chance is averaged over that.
    """
    agree = np.arange(COORDINATES + 1)
    chance = np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity)**(COORDINATES - k) for k in agree.tolist()])

    def lost(levels: int) -> np.ndarray:
        share = np.zeros(COORDINATES + 1)
        for _ in range(levels):
            share = np.exp(agree / (COORDINATES * similarity) * (share - 1))
        return share

    early, late = lost(min(depth, SHALLOW))**runs, lost(depth)
    return float(chance @ (early + (late**runs - early) * late**more))


def first_runs(recall: float, similarity: float) -> int:
    """Runs for all sets: those for ``recall`` at SHALLOW, with a fifth of the loss left to deeper pairs."""
    runs = runs_for(recall, similarity, SHALLOW)
    while lost_share(similarity, SHALLOW, runs) > 0.8 * (1 - recall):
        runs += 1
    return runs


def more_runs(recall: float, similarity: float, runs: int, depth: int) -> int:
    """Further runs for the sets split past SHALLOW, so that ``recall`` holds at ``depth``."""
    more = 0
    while lost_share(similarity, depth, runs, more) > 1 - recall:
        more += 1
    return more


def _alike(rows: DataFrame, group: str, sketches: DataFrame, close: float, bucket_rows: int) -> DataFrame:
    """Edges (a, b) inside each group of ``n`` rows whose sketches agree by ``close``; large groups in pairs of parts."""
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64(group, "id"), parts).cast("int")
    # A row of part p meets part q in the pair (min, max), numbered as one whole number.
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.least(own, q).cast("long") * parts + F.greatest(own, q))
    spread = rows.select(group, "id", F.explode(F.when(parts > 1, pairs).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    near = spread.join(sketches, "id").repartition(group, "part").sortWithinPartitions(group, "part")
    return near.mapInArrow(_bucket_edges(close, [group, "part"]), "a long, b long")


def _close(similarity: float) -> float:
    """Share of coordinates in which the sketches of a linked pair agree at least (four standard errors)."""
    return similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES)


def _refined(component: DataFrame, unsure: list[DataFrame], sets: DataFrame, similarity: float, bucket_rows: int) -> DataFrame:
    """Components (id, component) of over ``bucket_rows`` sets, cut into those connected by alike sketches.

    Sets around a core (ids in ``unsure``) need not be alike to any in it; sketches of
    fixed size tell it, so that sets are read and compared only among near copies. A
    component without such sets is connected by alike sketches already.
    """
    if not unsure:
        return component
    met = component.join(reduce(DataFrame.union, unsure), "id", "left_semi").select("component").distinct()
    large = component.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows)
    large = large.join(met, "component", "left_semi")
    placed = cut_lineage(component.join(large, "component"), "large")
    if not placed.limit(1).count():
        return component
    finer = connected_components(_alike(placed, "component", sets.select("id", "sketch"), _close(similarity), bucket_rows))
    small = component.join(placed.select("id"), "id", "left_anti")
    return small.unionByName(finer.withColumnRenamed("label", "component"))


def _candidate_edges(
    sets: DataFrame, similarity: float, recall: float, bucket_rows: int, deepest: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) that connect all sets which share a bucket and whose sketches are alike; ids connected for caution.

    Buckets of one row end. Those of up to ``bucket_rows`` are compared in one task.
    Larger ones meet a pivot first: rows close to it (the core) are connected
    through it and leave; rows that may still be linked to the core are connected
    too, unless the pivot is all of it, and stay with the rest, which is split on. By
    the triangle inequality of the Jaccard distance no other row is linked to the core,
    and none that is not close is linked to the pivot itself. What is large even at
    the deepest level is compared in pairs of parts. Sets that are split past SHALLOW
    get more runs, as many as the depth reached asks for.
    """
    runs = first_runs(recall, similarity)
    close = _close(similarity)
    ring = max(close - (1 - similarity) - (similarity - close), 0.05)
    split = _children(similarity)
    sketches = sets.select("id", "sketch")
    leaves, edges, unsure = [], [], []

    def descend(start: DataFrame, first: int, last: int) -> tuple[int, DataFrame | None]:
        """Runs ``first`` to ``last`` over the sets of ``start``: the depth reached, the ids split past SHALLOW."""
        roots = [int(v) for v in mixed(np.arange(first, last, dtype=np.uint64) + np.uint64(7919)).view(np.int64)]
        rows = start.select("id", F.explode(split(F.array(*[F.lit(r) for r in roots]), F.col("sketch"))).alias("path"))
        deep = None
        for depth in range(1, deepest + 1):
            # Written first, as only a join of two shuffles is split where a bucket is hot.
            sizes = cut_lineage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
            placed = cut_lineage(rows.join(sizes, "path"), "buckets")
            leaves.append(placed if depth == deepest else placed.filter(F.col("n") <= bucket_rows))
            large = placed.filter(F.col("n") > bucket_rows)
            if depth == deepest or not large.limit(1).count():
                break
            pivots = large.groupBy("path").agg(F.min("id").alias("pivot"))  # most buckets of a group share it
            pivots = pivots.join(sketches.select(F.col("id").alias("pivot"), F.col("sketch").alias("center")), "pivot")
            met = large.join(sketches, "id").join(pivots, "path")
            met = cut_lineage(met.withColumn(
                "alike", F.arrow_udf(_agreement, "double", F.ArrowUDFType.SCALAR_ITER)("sketch", "center")
            ).drop("center"), "met")
            others = met.filter(F.col("id") != F.col("pivot"))
            rest = met.filter(F.col("alike") < close)
            core = others.filter(F.col("alike") >= close)
            around = rest.filter(F.col("alike") >= ring).join(core.select("path").distinct(), "path", "left_semi")
            unsure.append(around.select("id"))
            edges.append(core.unionByName(around).select(F.col("id").alias("a"), F.col("pivot").alias("b")))
            if depth == SHALLOW:
                deep = rest.select("id").distinct()
            rows = rest.select("id", F.explode(split(F.array("path"), F.col("sketch"))).alias("path"))
        return depth, deep

    reached, deep = descend(sketches, 0, runs)
    if deep is not None:
        again = cut_lineage(sketches.join(deep, "id"), "deep")
        done, wanted = runs, runs + more_runs(recall, similarity, runs, reached)
        while done < wanted:
            reached = max(reached, descend(again, done, wanted)[0])
            done, wanted = wanted, runs + more_runs(recall, similarity, runs, reached)
    edges.append(_alike(reduce(DataFrame.union, leaves), "path", sketches, close, bucket_rows))
    return reduce(DataFrame.union, edges).distinct(), unsure


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8,
    recall: float = 0.999, bucket_rows: int = 512, block_shingles: int = 1 << 20, deepest: int = 8,
) -> DataFrame:
    """One row per document: ``key``, ``class_id``, ``n_links``.

    Two documents are linked if the Jaccard similarity of their sets of
    ``shingle``-word runs is at least ``similarity``; a shorter text is one run.
    ``n_links`` counts the other documents linked to this one, ``class_id`` is the
    smallest key of those connected to it by links, itself included.

    Documents with equal sets count as one with a multiplicity. Chosen paths over
    MinHash sketches gather candidates, their components are found by joins, large ones
    are cut where sketches are not alike, and inside each component every pair is
    compared once and exactly, in blocks of about ``block_shingles`` hashes; links are counted there and never listed. A
    missed pair costs a link only if no other path of candidates connects the two.

    Texts without words link to nothing. Rows of one key are documents of their
    own. A null key stays null and names no class, but its row links and connects like
    others. Other columns are not read.
    """
    named = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    members = cut_lineage(
        named.withColumn("s", _sketched(shingle)(F.col("text"))).select("key", "text_hash", "s.*"), "sketches")
    # One row stands for a set: its least key, or a null one, with the hash of the text, as a key may have many rows.
    sets = members.filter("size > 0").groupBy("high", "low").agg(
        F.min("key").alias("least"), F.coalesce(F.min_by("text_hash", "key"), F.min("text_hash")).alias("text_hash"),
        F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sets = cut_lineage(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    edges, unsure = _candidate_edges(sets, similarity, recall, bucket_rows, deepest)
    component = connected_components(edges).withColumnRenamed("label", "component")
    component = _refined(component, unsure, sets, similarity, bucket_rows)

    wanted = sets.join(component, "id").select("id", "component", "copies", "size", "high", "low", "least", "text_hash")
    weights = wanted.groupBy("component").agg(
        F.ceil(F.greatest(F.sum("size") / block_shingles, F.count(F.lit(1)) / bucket_rows)).cast("int").alias("blocks"))
    wanted = wanted.join(weights, "component")
    chosen = named.join(wanted, (named["text_hash"] == wanted["text_hash"]) & named["key"].eqNullSafe(wanted["least"]))
    chosen = chosen.withColumn("s", _shingled(shingle)(F.col("text"), F.col("id")))
    chosen = chosen.filter("s.high = high and s.low = low").select("id", "component", "copies", "blocks", "s.shingles")
    chosen = cut_lineage(chosen.dropDuplicates(["id"]), "candidates")

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pair = lambda q: F.struct(F.least(block, q).alias("one"), F.greatest(block, q).alias("two"))
    spread = chosen.select(
        "id", "component", "copies", "shingles", block.alias("block"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("pair"))
    spread = spread.select("*", "pair.one", "pair.two").drop("pair")
    groups = spread.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two")
    found = cut_lineage(groups.mapInArrow(_verified(similarity), "id long, links long, root long"), "verified")

    classes = connected_components(found.filter("links > 0").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    judged = sets.select("high", "low", "id", "least", "copies").join(links, "id", "left").join(classes, "id", "left")
    judged = judged.withColumn("label", F.coalesce("label", "id"))
    least = judged.groupBy("label").agg(F.min("least").alias("class_id"))
    judged = judged.join(least, "label").select(
        "high", "low", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = members.filter("size = 0").select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    linked = members.filter("size > 0").select("key", "high", "low").join(judged, ["high", "low"])
    return linked.select("key", "class_id", "n_links").union(alone).withColumnRenamed("key", key)
