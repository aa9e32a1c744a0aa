"""Exact and approximate nearest neighbours by cosine similarity.

Three facts keep the join small without giving up exactness:

* equal vectors are compared once. Of a group of copies only the lowest ids can
  ever be chosen, so each distinct vector keeps a bounded list of candidates;
* a candidate matrix below ``broadcast_bytes`` goes to every task, and sources
  stream past it once;
* beyond that size a task holds a strip of sources with the best found so far, and
  candidates stream past in blocks, each from one cell around a pivot. A source
  skips a block that lies beyond its k-th similarity so far (triangle inequality on
  unit vectors; Lu et al., "Efficient processing of k nearest neighbor joins using
  MapReduce", VLDB 2012). Strips and slices of candidates are as few as tasks need,
  so a vector is shuffled a fixed number of times until strips reach ``strip_bytes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.config import EngineConfig
from rewardloom.functions.vectors import dot, fingerprint, unit
from rewardloom.operators.ranking import first_rows
from rewardloom.session import cut_lineage

MAX_PIVOTS = 4096  # cells grow with the square root of the candidates, up to this
MAX_CELLS = 1 << 17  # cells that the driver takes; with more, domains are searched whole
CHUNK_CELLS = 4_000_000
SEARCH_CELLS = 1 << 19  # similarities that a search holds at once
PRODUCTS = 1 << 16  # pairs multiplied exactly at once
PACK_ROWS = 256  # vectors of one block at most
STRIPS, SLICES = 6, 8  # of sources, of candidates where both are alike; as many tasks in other shapes, more where they grow too large
NO_SOURCE_GROUP, NO_GROUP = -(1 << 63), -(1 << 63) + 1  # rows of no group exclude nothing
SLACK = 1e-9


def _prepare(df: DataFrame, group: str | None, domain: str | None) -> DataFrame:
    """Columns id, grp, dom, vec (unit) and the vector's 128-bit key."""
    vec = unit(F.col("embedding"))
    return df.select(
        F.col("id").cast("bigint").alias("id"),
        (F.col(group) if group else F.lit(None)).cast("bigint").alias("grp"),
        (F.col(domain) if domain else F.lit("")).cast("string").alias("dom"),
        vec.alias("vec"),
    ).select("*", fingerprint(F.col("vec")).alias("key"))


def _bounded_candidates(cand: DataFrame, k: int, exclude: str | None) -> DataFrame:
    """Drops copies that no source can ever choose."""
    same_vector = ["dom", "key"]
    if exclude == "group":
        # Excluding one group removes at most k of these 2k entries.
        cand = first_rows(cand, [*same_vector, "grp"], [F.col("id")], k)
        return first_rows(cand, same_vector, [F.col("id")], 2 * k)
    keep = k + 1 if exclude == "self" else k
    return first_rows(cand, same_vector, [F.col("id")], keep)


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Best k columns per row; ``ids`` ascend, so a stable sort breaks ties by id."""
    width = sims.shape[1]
    if width > k:
        kth = np.partition(sims, width - k, axis=1)[:, width - k]
    else:
        kth = np.full(len(sims), -np.inf)
    picks = []
    for row, limit in zip(sims, kth):
        near = np.flatnonzero((row >= limit) & (row > -np.inf))
        picks.append(near[np.argsort(-row[near], kind="stable")][:k])
    return picks


def _collapsed(cand: DataFrame, k: int, exclude: str | None) -> DataFrame:
    """One row per distinct vector with its first ids in order and their groups; ids are ranked without their vectors."""
    same = ["dom", "key"]
    entries = F.sort_array(F.collect_list(F.struct("id", F.coalesce("grp", F.lit(NO_GROUP)).alias("grp"))))
    listed = _bounded_candidates(cand.drop("vec"), k, exclude).groupBy(*same).agg(entries.alias("entries"))
    return cand.groupBy(*same).agg(F.first("vec").alias("vec")).join(listed, same).select(
        "dom", "vec", F.col("entries.id").alias("ids"), F.col("entries.grp").alias("grps"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Candidates:
    """Distinct vectors and, one after the other, the ids and groups that share each of them."""

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, ids: np.ndarray, groups: np.ndarray):
        self.vectors, self.counts, self.ids, self.groups = vectors, counts, ids, groups
        self.starts, self.coarse = np.cumsum(counts) - counts, vectors.astype(np.float32)

    def only_group(self) -> np.ndarray:
        """The group of all ids of a vector, or no group where they differ."""
        low, high = np.minimum.reduceat(self.groups, self.starts), np.maximum.reduceat(self.groups, self.starts)
        return np.where(low == high, low, NO_GROUP)


class _Best:
    """The best ``k`` candidates so far of some sources, by similarity, then by id."""

    def __init__(self, vectors: np.ndarray, groups: np.ndarray | None, k: int):
        self.vectors, self.groups, self.k = vectors, groups, k
        self.sims = np.full((len(vectors), k), -np.inf)
        self.ids = np.full((len(vectors), k), np.iinfo(np.int64).max)
        # Half the bytes to sift with; the margin is twice the error of such a product of unit vectors.
        self.coarse, self.margin = vectors.astype(np.float32), (vectors.shape[1] + 8) * 2.0 ** -23
        self.floor = np.full(len(vectors), -np.inf, np.float32)

    def meet(self, cand: _Candidates, rows: np.ndarray | None = None) -> None:
        """Compares all sources, or some rows, with all candidates; holds a bounded block of similarities."""
        wide = max(1, min(len(cand.vectors), 4 * PACK_ROWS))
        step = max(1, SEARCH_CELLS // wide)
        only = cand.only_group() if self.groups is not None and len(cand.ids) else None
        total = len(self.vectors) if rows is None else len(rows)
        for start in range(0, total, step):
            chosen = slice(start, min(start + step, total)) if rows is None else rows[start:start + step]
            left = self.coarse[chosen]
            for first in range(0, len(cand.vectors), wide):
                self._block(chosen, left, cand, first, min(first + wide, len(cand.vectors)), only)

    def _block(self, chosen: slice | np.ndarray, left: np.ndarray, cand: _Candidates, first: int, last: int,
               only: np.ndarray | None) -> None:
        sims = left @ cand.coarse[first:last].T
        hot = np.flatnonzero(sims.max(axis=1) >= self.floor[chosen])
        if not len(hot):
            return
        place = hot + chosen.start if isinstance(chosen, slice) else chosen[hot]
        hit = sims[hot] >= self.floor[place][:, None]
        if only is not None:
            hit &= self.groups[place][:, None] != only[None, first:last]
        if last - first > self.k and np.count_nonzero(hit) > 4 * self.k * len(hot):
            # Early blocks: of each row only what may reach its k-th best in this block.
            sims = np.where(hit, sims[hot], -np.inf)
            kth = np.partition(sims, last - first - self.k, axis=1)[:, last - first - self.k]
            hit &= sims >= (kth - 2 * self.margin)[:, None]
        row, column = np.nonzero(hit)
        if not len(row):
            return
        row, column = place[row], first + column
        near = np.concatenate([
            np.einsum("ij,ij->i", self.vectors[row[at:at + PRODUCTS]], cand.vectors[column[at:at + PRODUCTS]])
            for at in range(0, len(row), PRODUCTS)])
        entry = column
        if len(cand.ids) > len(cand.vectors):
            counts = cand.counts[column]
            before = np.cumsum(counts) - counts
            entry = np.repeat(cand.starts[column] - before, counts) + np.arange(counts.sum())
            row, near = np.repeat(row, counts), np.repeat(near, counts)
        ids = cand.ids[entry]
        worst, limit = self.sims[row, -1], self.ids[row, -1]
        keep = (near > worst) | ((near == worst) & (ids < limit))
        if self.groups is not None:
            keep &= self.groups[row] != cand.groups[entry]
        if keep.any():
            self._merge(row[keep], near[keep], ids[keep])

    def _merge(self, row: np.ndarray, near: np.ndarray, ids: np.ndarray) -> None:
        touched, place = np.unique(row, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        near = np.concatenate([self.sims[touched].ravel(), near])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -near, rows))
        starts = np.searchsorted(rows[order], np.arange(len(touched)))
        take = order[starts[:, None] + np.arange(self.k)]  # a row has k entries at least, if empty ones
        self.sims[touched], self.ids[touched] = near[take], ids[take]
        self.floor[touched] = self.sims[touched, -1] - self.margin

    def lists(self, part: slice = slice(None)) -> tuple[pa.Array, pa.Array]:
        """Ids and similarities found, one list a source."""
        full = self.sims[part] > -np.inf
        ends = np.concatenate([[0], np.cumsum(full.sum(axis=1))]).astype(np.int32)
        return (pa.ListArray.from_arrays(pa.array(ends), pa.array(self.ids[part][full])),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(self.sims[part][full])))


FOUND = "h1 bigint, h2 bigint, dom string, grp bigint, dst array<bigint>, sim array<double>"


def _found_batch(h1, h2, dom, groups: np.ndarray, best: _Best, part: slice = slice(None)) -> pa.RecordBatch:
    dst, sim = best.lists(part)
    grp = pa.array(groups, mask=groups == NO_SOURCE_GROUP)
    columns = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(dom, pa.string()), grp, dst, sim]
    return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "dom", "grp", "dst", "sim"])


def _groups_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_SOURCE_GROUP).to_numpy(zero_copy_only=False)


def _domains(column: pa.Array) -> Iterator[tuple[str | None, np.ndarray]]:
    """Each domain of a batch with its rows."""
    names = column.dictionary_encode(null_encoding="encode")
    codes = names.indices.to_numpy(zero_copy_only=False)
    for code, name in enumerate(names.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == code)


def _broadcast_search(src: DataFrame, rows: pa.Table, k: int, by_group: bool) -> DataFrame:
    arrays = {}
    for batch in rows.combine_chunks().to_batches():
        for dom, at in _domains(batch["dom"]):
            part = batch.take(pa.array(at))
            counts = part["ids"].value_lengths().to_numpy()
            arrays[dom] = (_matrix(part["vec"]), counts, part["ids"].flatten().to_numpy(), part["grps"].flatten().to_numpy())
    shared = src.sparkSession.sparkContext.broadcast(arrays)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = {dom: _Candidates(*parts) for dom, parts in shared.value.items()}
        for batch in batches:
            for dom, at in _domains(batch["dom"]):
                if dom in matrices and len(at):
                    part = batch.take(pa.array(at))
                    groups = _groups_of(part["grp"])
                    best = _Best(_matrix(part["vec"]), groups if by_group else None, k)
                    best.meet(matrices[dom])
                    yield _found_batch(part["h1"], part["h2"], part["dom"], groups, best)

    return src.mapInArrow(search, FOUND)


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (vectors @ pivots.T)))


def _with_cell(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and its distance. Zero vectors get cell -1."""

    @F.pandas_udf("struct<cell: int, away: double>")
    def locate(vec: pd.Series) -> pd.DataFrame:
        if not len(vec):
            return pd.DataFrame({"cell": np.empty(0, np.int32), "away": np.empty(0)})
        matrix = np.vstack(vec.to_numpy())
        away = _nearest(matrix, pivots)
        cell = away.argmin(axis=1)
        best = away[np.arange(len(cell)), cell]
        zero = ~matrix.any(axis=1)
        return pd.DataFrame({"cell": np.where(zero, -1, cell), "away": np.where(zero, 0.0, best)})

    located = df.withColumn("_at", locate("vec"))
    return located.select(*df.columns, "_at.cell", "_at.away")


def _renewed(df: DataFrame) -> DataFrame:
    """Fresh column identities, so that a table can be cogrouped with its relative."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _splits(size, block_rows: int):
    return F.greatest(F.lit(1), F.ceil(size / F.lit(block_rows))).cast("int")


# A block: n vectors of one domain as bytes. ``p, q, r`` are key halves, groups and reach limits
# of sources, or id counts, ids and groups of candidates, which all lie in one cell.
BLOCK = "dom string, n int, vec binary, p binary, q binary, r binary, cell int, lo double, hi double, mark bigint"
BLOCK_NAMES = [part.split()[0] for part in BLOCK.split(", ")]


def _block_batch(blocks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4, pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*blocks), kinds)]
    return pa.RecordBatch.from_arrays(columns, BLOCK_NAMES)


def _source_blocks(src: DataFrame, pivots: np.ndarray, rows: int, probes: int | None,
                   cells: dict[str | None, np.ndarray] | None) -> DataFrame:
    """Packed sources. With ``probes`` each carries the distance of the last cell that it opens."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dom, every in _domains(batch["dom"]):
                for start in range(0, len(every), rows):
                    part = batch.take(pa.array(every[start:start + rows]))
                    matrix = _matrix(part["vec"])
                    limits = np.full(len(matrix), np.inf)
                    known = None if cells is None else cells.get(dom)
                    if known is not None and probes < len(known):
                        # The cell of zero vectors is open to all and counts as one.
                        away = _nearest(matrix, pivots[known[known >= 0]])
                        last = max(0, probes - 1 - int((known < 0).any()))
                        limits = np.partition(away, last, axis=1)[:, last]
                    keys = np.stack([part["h1"].to_numpy(), part["h2"].to_numpy()])
                    yield _block_batch([(dom, len(matrix), matrix.tobytes(), keys.tobytes(),
                                         _groups_of(part["grp"]).tobytes(), limits.tobytes(), -1, 0.0, 0.0, int(keys[0, 0]))])

    return src.mapInArrow(pack, BLOCK)


def _candidate_blocks(located: DataFrame, rows: int) -> DataFrame:
    """Packed candidates, each block from one cell, with the ring around the pivot that it lies in."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dom, every in _domains(batch["dom"]):
                numbers = batch["cell"].to_numpy(zero_copy_only=False)[every]
                for cell in np.unique(numbers):
                    inside = every[numbers == cell]
                    for start in range(0, len(inside), rows):
                        part = batch.take(pa.array(inside[start:start + rows]))
                        away, ids = part["away"].to_numpy(), part["ids"].flatten().to_numpy()
                        counts = part["ids"].value_lengths().to_numpy().astype(np.int64)
                        yield _block_batch([(dom, len(part), _matrix(part["vec"]).tobytes(), counts.tobytes(), ids.tobytes(),
                                             part["grps"].flatten().to_numpy().tobytes(), int(cell),
                                             float(away.min()), float(away.max()), int(ids[0]))])

    return located.repartition("dom", "cell").sortWithinPartitions("dom", "cell").mapInArrow(pack, BLOCK)


class _Strip:
    """Sources of one domain in one task, and what they have found."""

    def __init__(self, blocks: list[dict], k: int, by_group: bool):
        numbers = lambda name, kind: [np.frombuffer(b[name], kind) for b in blocks]
        vectors = np.concatenate([v.reshape(b["n"], -1) for v, b in zip(numbers("vec", np.float64), blocks)])
        self.keys = np.concatenate([p.reshape(2, -1) for p in numbers("p", np.int64)], axis=1)
        self.groups, self.limits = np.concatenate(numbers("q", np.int64)), np.concatenate(numbers("r", np.float64))
        self.zero = ~vectors.any(axis=1)
        self.best = _Best(vectors, self.groups if by_group else None, k)

    def meet(self, block: dict, pivots: np.ndarray, exact: bool) -> None:
        vectors = np.frombuffer(block["vec"], np.float64).reshape(block["n"], -1)
        cand = _Candidates(vectors, *[np.frombuffer(block[name], np.int64) for name in "pqr"])
        rows = None
        if block["cell"] >= 0:
            away = _nearest(self.best.vectors, pivots[block["cell"]][None, :])[:, 0]
            if exact:
                low = np.maximum(away - block["hi"], block["lo"] - away)
                worst = self.best.sims[:, -1]
                near = low <= np.where(worst > -1, np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(worst, -1))), np.inf) + SLACK
            else:
                near = away <= self.limits + SLACK
            near |= self.zero
            if not near.all():
                rows = np.flatnonzero(near)
        if rows is None or len(rows):
            self.best.meet(cand, rows)

    def found(self, dom: str | None, rows: int) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.groups), rows):
            part = slice(start, start + rows)
            names = [dom] * len(self.groups[part])
            yield _found_batch(self.keys[0, part], self.keys[1, part], names, self.groups[part], self.best, part)


@dataclass(frozen=True)
class Index:
    """Candidates in stored blocks, for as many searches as read them, and the cells of each domain if few enough."""

    blocks: DataFrame
    pivots: np.ndarray
    cells: dict[str | None, np.ndarray] | None


def _indexed(cand: DataFrame, config: EngineConfig, probing: bool) -> Index:
    usable = cand.where(F.exists("vec", lambda x: x != 0))
    wanted = int(min(MAX_PIVOTS, max(1, round(usable.count() ** 0.5))))
    picked = usable.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(wanted).select("vec").collect()
    if picked:
        pivots = np.vstack([row["vec"] for row in picked])
    else:  # no candidate points anywhere: one arbitrary pivot will do
        first = cand.select(F.size("vec").alias("d")).head(1)
        pivots = np.ones((1, first[0]["d"] if first else 1))

    blocks = cut_lineage(_candidate_blocks(_with_cell(cand, pivots), _block_rows(config)), "candidates")
    cells = None
    if probing:
        known = blocks.select("dom", "cell").distinct().limit(MAX_CELLS + 1).toPandas()
        if len(known) <= MAX_CELLS:
            cells = {dom: part["cell"].to_numpy() for dom, part in known.groupby("dom", dropna=False)}
    return Index(blocks, pivots, cells)


def search_index(candidates: DataFrame, k: int, *, exclude: str | None = None, group: str | None = None,
                 domain: str | None = None, config: EngineConfig = EngineConfig()) -> Index:
    """Candidates made ready once for several searches by :func:`knn_edges` with the same ``k`` and options."""
    prepared = _prepare(candidates, group if exclude == "group" else None, domain)
    return _indexed(cut_lineage(_collapsed(prepared, k, exclude), "distinct"), config, True)


def _block_rows(config: EngineConfig) -> int:
    return max(1, min(config.block_rows, PACK_ROWS))


def _grid(sources: tuple[int, int], candidates: tuple[int, int], strip_bytes: int) -> tuple[int, int]:
    """Strips and slices, from the number of blocks and the bytes of both sides: of shapes of about as many tasks the one that shuffles least.

    A source goes to every slice and a candidate to every strip, so that few sources
    make few strips.
    """
    tasks = STRIPS * SLICES
    shapes = [(min(strips, sources[0]), min(tasks // strips, candidates[0]))
              for strips in range(1, min(tasks, max(1, sources[0])) + 1) if tasks % strips == 0]
    most = max(strips * slices for strips, slices in shapes)
    strips, slices = min((s for s in shapes if 2 * s[0] * s[1] >= most), key=lambda s: (s[0] * candidates[1] + s[1] * sources[1], s))
    strips = min(sources[0], max(strips, -(-sources[1] // strip_bytes)))
    slices = min(candidates[0], max(slices, -(-candidates[1] // (4 * strip_bytes))))
    return max(1, strips), max(1, slices)


def _strip_search(src: DataFrame, index: Index, k: int, by_group: bool, config: EngineConfig,
                  probes: int | None) -> DataFrame:
    """Strips of sources, slices of candidates, one pass: ``h1, h2, dom, grp, dst, sim``.

    A block is skipped by sources whose k-th similarity so far it cannot reach;
    with ``probes`` by those that have so many nearer cells.
    """
    pivots, cand_blocks = index.pivots, index.blocks
    cells = None if probes is None else index.cells
    src_blocks = cut_lineage(_source_blocks(src, pivots, _block_rows(config), probes, cells), "sources")

    def extent(blocks: DataFrame) -> tuple[int, int]:
        return tuple(blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")), F.lit(0))).head())

    strips, slices = _grid(extent(src_blocks), extent(cand_blocks), config.strip_bytes)
    spot = lambda count: F.pmod(F.xxhash64("dom", "mark"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = src_blocks.select(spot(strips).alias("strip"), every(slices).alias("slice"), F.lit(0).alias("side"), *BLOCK_NAMES).unionByName(
        cand_blocks.select(every(strips).alias("strip"), spot(slices).alias("slice"), F.lit(1).alias("side"), *BLOCK_NAMES))
    dealt = dealt.withColumn("task", F.col("strip") * slices + F.col("slice")).drop("strip", "slice", "mark")
    exact = probes is None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, held = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch[name][i].as_py() if name not in ("vec", "p", "q", "r") else batch[name][i].as_buffer()
                         for name in batch.schema.names}
                if block["task"] != task:
                    for dom, strip in held.items():
                        yield from strip.found(dom, 10_000)
                    task, waiting, held = block["task"], {}, {}
                if block["side"] == 0:
                    waiting.setdefault(block["dom"], []).append(block)
                    continue
                if block["dom"] in waiting:
                    held[block["dom"]] = _Strip(waiting.pop(block["dom"]), k, by_group)
                if block["dom"] in held:
                    held[block["dom"]].meet(block, pivots, exact)
        for dom, strip in held.items():
            yield from strip.found(dom, 10_000)

    partial = dealt.repartitionById(strips * slices, F.col("task")).sortWithinPartitions("task", "side").mapInArrow(search, FOUND)
    hit = F.transform(F.arrays_zip("dst", "sim"), lambda h: F.struct((-h["sim"]).alias("s"), h["dst"].alias("d")))
    merged = partial.groupBy("h1", "h2", "dom", "grp").agg(F.slice(F.array_sort(F.flatten(F.collect_list(hit))), 1, k).alias("m"))
    return merged.select("h1", "h2", "dom", "grp", F.transform("m", lambda x: x["d"]).alias("dst"),
                         F.transform("m", lambda x: -x["s"]).alias("sim"))


def knn_edges(sources: DataFrame, candidates: DataFrame, k: int, *, exclude: str | None = None,
              group: str | None = None, domain: str | None = None, min_sim: float = -1.0,
              config: EngineConfig = EngineConfig(), probes: int | None = None, index: Index | None = None) -> DataFrame:
    """Edges ``(src, dst, sim)`` to the k most similar candidates of each source.

    Both inputs carry ``id`` (bigint) and ``embedding`` (array<double>).
    ``exclude="self"`` skips the source's own id, ``exclude="group"`` every
    candidate with the same ``group``. ``domain`` limits neighbours to an equal
    value. Ties go to the lower id. ``probes`` makes the search approximate. An
    ``index`` of the candidates by :func:`search_index` saves preparing them again.
    """
    by_group = exclude == "group"
    need = k + 1 if exclude == "self" else k
    src = _prepare(sources, group if by_group else None, domain)
    keys = ["dom", "key", "grp"] if by_group else ["dom", "key"]
    distinct = src.groupBy(*keys).agg(F.first("vec").alias("vec"))
    if not by_group:
        distinct = distinct.withColumn("grp", F.lit(None).cast("bigint"))
    distinct = distinct.select(
        F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"), "dom", "grp", "vec"
    )

    join_keys = ["h1", "h2", "dom", "grp"] if by_group else ["h1", "h2", "dom"]
    small = None
    if index is None:
        width = candidates.select(F.size("embedding").alias("d")).head(1)
        row_bytes = 8 * (width[0]["d"] if width else 1) + 64
        limit = max(1, config.broadcast_bytes // row_bytes)
        cand = _collapsed(_prepare(candidates, group if by_group else None, domain), k, exclude)
        # Counted before anything is taken: by rows where that is enough, else by what copies leave.
        fits = probes is None and candidates.count() <= limit
        if not fits:
            cand = cut_lineage(cand, "distinct")
            fits = probes is None and cand.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).head()[0] <= limit
        if fits:
            small = cand.toArrow()
        else:
            index = _indexed(cand, config, probes is not None)
    if small is not None:
        found = _broadcast_search(distinct, small, need, by_group)
    else:
        found = _strip_search(distinct, index, need, by_group, config, probes)

    back = src.select("id", F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"), "dom", "grp")
    if not by_group:
        back = back.drop("grp")
        found = found.drop("grp") if "grp" in found.columns else found
    hits = back.join(found, join_keys).select("id", F.arrays_zip("dst", "sim").alias("hits"))
    own = F.col("id")
    listed = F.filter("hits", lambda h: h["sim"] > min_sim)
    if exclude == "self":
        listed = F.filter(listed, lambda h: h["dst"] != own)
    return hits.select(
        F.col("id").alias("src"), F.explode(F.slice(listed, 1, k)).alias("h")
    ).select("src", F.col("h.dst").alias("dst"), F.col("h.sim").alias("sim"))


def approximate_edges(sources: DataFrame, candidates: DataFrame, k: int, probes: int = 8,
                      **options) -> DataFrame:
    """As :func:`knn_edges`, but each source visits only its nearest cells."""
    return knn_edges(sources, candidates, k, probes=probes, **options)


def edges_for_recall(sources: DataFrame, candidates: DataFrame, k: int, target: float = 0.9, probes: int = 8,
                     sample: int = 1000, index: Index | None = None, min_sim: float = -1.0, **options) -> tuple[DataFrame, int]:
    """Approximate edges of all sources that hold about ``target`` of the exact ones, and the probes they took.

    The share of cells that a fixed number of probes opens falls as cells grow, so
    probes are doubled until the recall is enough, measured over ``sample`` sources
    drawn by hash; with all cells open it is 1. Then all sources are searched once.
    All rounds read one index.
    """
    index = index or search_index(candidates, k, **options)
    options |= {"index": index, "min_sim": min_sim}
    tried = cut_lineage(sources.orderBy(F.xxhash64("id", F.lit("probes")), "id").limit(sample), "sample")
    exact = cut_lineage(knn_edges(tried, candidates, k, **options), "exact")
    while probes <= MAX_PIVOTS:
        found = approximate_edges(tried, candidates, k, probes, **options)
        share = recall(exact, found).first()["recall"]
        if share is None or share >= target:
            break
        probes *= 2
    return cut_lineage(approximate_edges(sources, candidates, k, probes, **options), "approximate"), probes


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of exact edges that an approximate search found."""
    marked = exact.join(found.select("src", "dst", F.lit(1).alias("_hit")), ["src", "dst"], "left")
    return marked.agg(
        F.count("*").alias("exact_edges"),
        F.count("_hit").alias("found_edges"),
        F.round(F.count("_hit") / F.count("*"), 6).alias("recall"),
    )


SMALL_GROUP = 64


def knn_within_groups(nodes: DataFrame, group: str, k: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Top-k neighbours inside each group: ``(src, dst, sim)``.

    Usual groups hold a few rollouts and are ranked as one array in the JVM.
    Larger groups are cut into blocks, and blocks meet pairwise in bounded tasks.
    """
    base = nodes.select(
        F.col("id").cast("bigint").alias("id"), F.col(group).alias("grp"), unit(F.col("embedding")).alias("vec")
    )
    sizes = base.groupBy("grp").agg(F.count("*").alias("n"))
    sized = base.join(sizes, "grp")

    member = F.struct("id", "vec")
    packed = sized.where(F.col("n") <= SMALL_GROUP).groupBy("grp").agg(F.collect_list(member).alias("members"))
    each = packed.select("members", F.explode("members").alias("me"))
    ranked = F.slice(F.array_sort(F.transform(
        F.filter("members", lambda m: m["id"] != F.col("me.id")),
        lambda m: F.struct((-dot(F.col("me.vec"), m["vec"])).alias("s"), m["id"].alias("d")),
    )), 1, k)
    small = each.select(F.col("me.id").alias("src"), F.explode(ranked).alias("h")).select(
        "src", F.col("h.d").alias("dst"), (-F.col("h.s")).alias("sim")
    )

    large = sized.where(F.col("n") > SMALL_GROUP).withColumn("parts", _splits(F.col("n"), config.block_rows))
    large = large.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)
    left = large.select("grp", F.col("part").alias("a"), F.explode(every).alias("b"), "id", "vec")
    right = large.select("grp", F.explode(every).alias("a"), F.col("part").alias("b"), "id", "vec")
    right = _renewed(right)
    keys = ["grp", "a", "b"]

    def meet(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"src": [], "dst": [], "sim": []})
        theirs = theirs.sort_values("id", kind="stable")
        ids = theirs["id"].to_numpy(np.int64)
        matrix = np.vstack(theirs["vec"].to_numpy())
        vectors, own = np.vstack(mine["vec"].to_numpy()), mine["id"].to_numpy(np.int64)
        step = max(1, CHUNK_CELLS // len(ids))
        src, dst, near = [], [], []
        for start in range(0, len(own), step):
            sims = vectors[start:start + step] @ matrix.T
            chunk = own[start:start + step]
            sims[chunk[:, None] == ids[None, :]] = -np.inf
            picks = _top(sims, ids, k)
            src.append(np.repeat(chunk, [len(p) for p in picks]))
            dst += [ids[p] for p in picks]
            near += [row[p] for row, p in zip(sims, picks)]
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "sim": np.concatenate(near)})

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet, "src bigint, dst bigint, sim double")
    return small.unionByName(first_rows(partial, ["src"], [F.col("sim").desc(), F.col("dst")], k))


def degree_mix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges per pair of source and destination domains."""
    left = nodes.select(F.col("id").alias("src"), F.col("domain").alias("src_domain"))
    right = nodes.select(F.col("id").alias("dst"), F.col("domain").alias("dst_domain"))
    return (
        edges.join(left, "src").join(right, "dst")
        .groupBy("src_domain", "dst_domain").agg(F.count("*").alias("edges"))
    )
