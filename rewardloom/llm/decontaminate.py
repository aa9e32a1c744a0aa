"""Benchmark decontamination with one Aho-Corasick automaton over the words of normalised items."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm.words import mixed, window_hashes
from rewardloom.session import cut_lineage

# Bytes of lower-cased words stay, all other ASCII becomes a blank. Bytes from 0x80 belong to words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def benchmark_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8; the translation keeps every byte's offset."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


def item_pieces(text: str | None, window: int, most: int = 1 << 16) -> list[bytes]:
    """Words of an item, joined by blanks; a longer item is cut where pieces overlap by all but one word of a window."""
    words = benchmark_words(text)
    step = max(most - window + 1, 1)
    return [b" ".join(words[i:i + step + window - 1]) for i in range(0, max(len(words) - window + 1, 1), step)] if words else []


class Automaton:
    """Aho-Corasick automaton over the words of one part of the items.

    Its patterns are items shorter than a window, and of the longer ones ``seed``
    words at every ``window - seed + 1``-th place, so that every window holds one.
    A found seed names the windows around it; they are looked up by their hash and
    compared word by word. The automaton searches the children of a node one by one,
    so a word is three digits of its number, each place with symbols of its own: no
    node has more children than the cube root of the vocabulary.
    """

    def __init__(self, pieces: list[bytes], owners: list[list[str]], window: int, seed: int = 4):
        self.owners, self.window, self.seed = owners, window, min(seed, window)
        split = [p.split(b" ") for p in pieces]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        lengths = np.array([len(p) for p in split], np.int64)
        self.words = np.fromiter((number(w, len(self.vocabulary) + 1) for p in split for w in p), np.int32, int(lengths.sum()))
        base = next(b for b in count(2) if b**3 > len(self.vocabulary))
        self.symbols = ["".join(chr(0x100 + place * base + n // base**place % base) for place in range(3))
                        for n in range(len(self.vocabulary) + 1)]
        first = np.cumsum(lengths) - lengths
        piece = np.repeat(np.arange(len(split), dtype=np.int32), lengths)
        offset = np.arange(len(self.words)) - first[piece]
        self._index(np.flatnonzero(lengths[piece] - offset >= window), piece)

        self.compiled = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        short: dict[tuple[int, ...], list[int]] = {}
        for p in np.flatnonzero(lengths < window).tolist():
            short.setdefault(tuple(self.words[first[p]:first[p] + lengths[p]].tolist()), []).append(p)
        self.short = [(len(key), own) for key, own in short.items()]
        # A value is twice the number of the short item, from 1, plus 1 if the pattern is a seed.
        for place, key in enumerate(short, 1):
            self.compiled.add_word(self._spelled(key), 2 * place)
        step = window - self.seed + 1
        starts = np.flatnonzero((lengths[piece] >= window) & (offset % step == 0) & (lengths[piece] - offset >= self.seed))
        for i in range(0, len(starts), 1 << 16):
            for key in map(self._spelled, self.words[starts[i:i + (1 << 16), None] + np.arange(self.seed)].tolist()):
                self.compiled.add_word(key, self.compiled.get(key, 0) | 1)
        self.compiled.make_automaton()

    def _spelled(self, numbers: Iterable[int]) -> str:
        return "".join(map(self.symbols.__getitem__, numbers))

    def _index(self, starts: np.ndarray, piece: np.ndarray) -> None:
        """Distinct windows by hash: a place where each stands, and the pieces that hold it."""
        clash, self.salt = True, 0
        while clash:  # another salt where two different windows share a hash
            self.salt += 1
            hashes = self._hashes(self.words)[starts]
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.group = np.unique(hashes[order], return_index=True)
            at = starts[order]
            self.at = at[self.group].astype(np.int32)
            of = np.repeat(np.arange(len(self.group)), np.diff(np.append(self.group, len(at))))
            clash = not all((self.words[at + k] == self.words[self.at[of] + k]).all() for k in range(self.window))
        self.group = np.append(self.group, len(at)).astype(np.int32)
        self.holders = piece[at]

    def _hashes(self, numbers: np.ndarray) -> np.ndarray:
        return window_hashes(mixed(numbers.astype(np.uint64) + np.uint64(self.salt << 40)), self.window)

    def _windows(self, numbers: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of benchmark windows that hold one of the seeds found, and which windows they are."""
        last = len(numbers) - self.window
        if last < 0 or not len(seeds):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        edges = np.zeros(last + 2, np.int64)
        np.add.at(edges, np.clip(seeds - self.window + self.seed, 0, last + 1), 1)
        np.add.at(edges, np.minimum(seeds, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        hashes = self._hashes(numbers)[starts]
        which = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[which] == hashes
        for k in range(self.window):
            same &= self.words[np.where(same, self.at[which] + k, 0)] == numbers[starts + k]
        return starts[same], which[same]

    def mark(self, words: list[bytes], hit: np.ndarray, items: set[str]) -> None:
        """Marks the words inside an occurrence of a window and adds the items it belongs to."""
        if not len(self.compiled):
            return
        numbers = list(map(self.vocabulary.get, words, repeat(0)))
        found = np.array(list(self.compiled.iter(self._spelled(numbers))), np.int64).reshape(-1, 2)
        if not len(found):
            return
        found[:, 0] //= 3  # digits to words
        ends, values = found.T
        edges = np.zeros(len(words) + 1, np.int64)
        seeds = ends[values % 2 == 1] - self.seed + 1
        starts, which = self._windows(np.array(numbers, np.int32), seeds)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + self.window, -1)
        pieces = {int(p) for w in np.unique(which) for p in self.holders[self.group[w]:self.group[w + 1]]}
        for end, value in found[values > 1].tolist():
            length, holders = self.short[value // 2 - 1]
            edges[end - length + 1] += 1
            edges[end + 1] -= 1
            pieces.update(holders)
        for p in pieces:
            items.update(self.owners[p])
        hit |= np.cumsum(edges[:-1]) > 0


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and word after the last of each run of hit words."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return turns[::2], turns[1::2]


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words, as word numbers and as code point offsets of the original text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate(([False], np.frombuffer(_WORD_BYTES, np.uint8)[raw] != 0x20, [False]))
    turns = np.flatnonzero(np.diff(inside.astype(np.int8)))
    starts, ends = turns[::2], turns[1::2]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [
        {"word": int(a), "after": int(b), "start": int(points[starts[a]]), "end": int(points[ends[b - 1]])}
        for a, b in zip(*_runs(hit), strict=True)
    ]


def benchmark_parts(benchmark: DataFrame, item: str, text: str, window: int, part_words: int) -> Iterator[dict]:
    """Distinct item texts with their items, in parts of about ``part_words`` words, one automaton each.

    A part is what a broadcast and a worker hold at a time. A larger benchmark
    gives more parts, each scanned over all documents; nothing is left out.
    """
    pieces = F.udf(lambda t: item_pieces(t, window), "array<binary>")
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
                            F.explode(pieces(F.col(text))).alias("piece"))
    part, size, given = {"pieces": [], "owners": [], "window": window}, 0, 0
    for row in rows.groupBy("piece").agg(F.collect_set("item").alias("items")).toLocalIterator():
        part["pieces"].append(bytes(row["piece"]))
        part["owners"].append(row["items"])
        size += row["piece"].count(b" ") + len(row["items"])
        if size >= part_words:
            yield part
            part, size, given = {"pieces": [], "owners": [], "window": window}, 0, given + 1
    if part["pieces"] or not given:
        yield part


_SPAN = "struct<word: int, after: int, start: int, end: int>"
_HITS = f"struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<{_SPAN}>>"
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([(name, pa.int32()) for name in ("word", "after", "start", "end")]))),
])


def _scan(part: Broadcast) -> Callable:
    """Judges whole texts by one part, on top of what earlier parts have found."""
    def judge(automaton: Automaton, text: str | None, before: dict | None) -> dict:
        words = benchmark_words(text)
        hit, items = np.zeros(len(words), bool), set(before["items"] if before else ())
        for run in before["spans"] if before else ():
            hit[run["word"]:run["after"]] = True
        automaton.mark(words, hit, items)
        return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(items),
                "spans": _spans(text, hit) if hit.any() else []}

    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # A worker keeps the broadcast, and with it the automaton, over the tasks it runs.
        if "automaton" not in part.value:
            part.value["automaton"] = Automaton(**part.value)
            del part.value["pieces"]
        automaton = part.value["automaton"]
        for texts, before in batches:
            yield pa.array([judge(automaton, t.as_py(), b.as_py()) for t, b in zip(texts, before, strict=True)], _ARROW)

    return F.arrow_udf(scan, _HITS, F.ArrowUDFType.SCALAR_ITER)


def contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 13, one_in: int = 20, part_words: int = 10_000_000,
) -> DataFrame:
    """Documents with a struct ``hits`` (n_words, n_hit, items, spans, contaminated) beside their columns.

    Texts are lower-cased (A-Z) and cut into words of digits, letters and
    characters beyond ASCII. A window is ``window`` consecutive words of an item,
    or the whole of a shorter one. The automaton reads a document once; ``n_hit``
    counts words inside any occurrence, ``items`` names the items in string order,
    ``spans`` gives the runs as word numbers and as code point offsets of the
    original text. Contaminated: one word in ``one_in`` is hit, and one at least.

    A benchmark of up to ``part_words`` words (100,000 items of 100 words: 1.1 GB in a
    worker, built once in 23 s) is one automaton and one scan; what is beyond goes to a
    further automaton and pass, with the state between passes in the shared folder.

    A null or empty text has no words; an item without words matches nothing; a
    null item id is named ``null``; repeated rows are judged each; other columns
    are kept, except that one named ``hits`` is replaced.
    """
    context = documents.sparkSession.sparkContext
    judged = documents.withColumn("hits", F.lit(None).cast(_HITS))
    for number, part in enumerate(benchmark_parts(benchmark, item, item_text, window, part_words)):
        judged = cut_lineage(judged, "contamination") if number else judged
        judged = judged.withColumn("hits", _scan(context.broadcast(part))(F.col(text), F.col("hits")))
    bad = (F.col("hits.n_hit") > 0) & (one_in * F.col("hits.n_hit") >= F.col("hits.n_words"))
    return judged.withColumn("hits", F.col("hits").withField("contaminated", bad))
