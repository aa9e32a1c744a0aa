"""Conversation structure repair: the cheapest edits that make turns alternate, by one integer weight per path.

A path through the rows of a conversation costs edits and spells an audit, one
letter an edit. Its weight is a single big integer: the cost in the high digits,
below it a fixed number of digits that hold the letters in order, with zeros
after the last one. Comparing two integers then compares costs first and audits
in ASCII order next, so an ordinary minimum over the edges of a DAG (row by
state) decides everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = " \t\n\x0b\x0c\r"
LETTERS = " DIKR"  # digit of a letter: its place, so that digits order as letters do; 0 is end padding
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
CUT_SHORT = 5
# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BITS = 3  # a digit
BLOCK = 64  # rows after which the letters of a path are put away
WIDTH = 1 + 3 * BLOCK + 2  # rank, at most two inserts and a letter a row, two inserts at the end
TOP = BITS * WIDTH


@dataclass
class _Path:
    """The best path into one state."""

    weight: int = 0
    used: int = 1  # digits used; the first one is the rank
    before: tuple | None = None  # letters of earlier blocks: (earlier, digits, how many)
    digest: object = field(default_factory=hashlib.sha256)

    def step(self, letter: int, extra: int = 0) -> tuple[int, int]:
        return self.weight + ((COSTS[letter] + extra) << TOP) + (letter << BITS * (WIDTH - 1 - self.used)), self.used + 1


def _digits(weight: int, used: int) -> str:
    return "".join(LETTERS[weight >> BITS * (WIDTH - 1 - at) & 7] for at in range(1, used))


class Repair:
    """Reads the rows of one conversation in order, in memory for four paths and their letters."""

    def __init__(self) -> None:
        self.paths = {START: _Path()}
        self.rows = 0

    def _inserted(self) -> dict[int, tuple[int, int, int, int]]:
        """Best ``weight, used, origin, inserts`` of each state after up to two inserts; a third only repeats a state."""
        best: dict[int, tuple[int, int, int, int]] = {}
        for origin, path in self.paths.items():
            state, weight, used = origin, path.weight, path.used
            for inserts in range(3):
                if state not in best or weight < best[state][0]:
                    best[state] = (weight, used, origin, inserts)
                weight += (COSTS[INSERT] << TOP) + (INSERT << BITS * (WIDTH - 1 - used))
                state, used = NEXT[state], used + 1
        return best

    @staticmethod
    def _said(path: _Path, origin: int, inserts: int, state: int, turn: str | None) -> object:
        """The digest of the text so far with inserted turns and perhaps a turn of the row behind it."""
        digest = path.digest.copy()
        for _ in range(inserts):
            digest.update((("\n" if origin != START else "") + ROLES[NEXT[origin]] + ":").encode())
            origin = NEXT[origin]
        if turn is not None:
            digest.update((("\n" if origin != START else "") + turn).encode("utf-8", "surrogatepass"))
        return digest

    def push(self, role: str, text: str, gone: bool, short: bool) -> None:
        """One row; ``gone`` rows have to be deleted, ``short`` ones cost more unless they are."""
        extra = CUT_SHORT if short else 0
        best: dict[int, tuple] = {}

        def offer(target: int, weight: int, used: int, origin: int, inserts: int, turn: str | None) -> None:
            if target not in best or weight < best[target][0]:
                best[target] = (weight, used, origin, inserts, turn)

        for state, (weight, used, origin, inserts) in self._inserted().items():
            path = _Path(weight, used, None, None)
            offer(state, *path.step(DELETE), origin, inserts, None)
            if gone:
                continue
            kept = SYSTEM if state == START and role[:1] == "s" else (
                NEXT[state] if role[:1] == ROLES[NEXT[state]][:1] else None)
            if kept is not None:
                offer(kept, *path.step(KEEP, extra), origin, inserts, f"{role}:{text}")
            offer(NEXT[state], *path.step(REROLE, extra), origin, inserts, f"{ROLES[NEXT[state]]}:{text}")
        self.paths = {
            state: _Path(weight, used, self.paths[origin].before, self._said(self.paths[origin], origin, inserts, state, turn))
            for state, (weight, used, origin, inserts, turn) in best.items()}
        self.rows += 1
        if self.rows % BLOCK == 0:
            self._put_away()

    def _put_away(self) -> None:
        """Moves the letters of a block out of the weights; what is left of them is their rank.

        All paths have spent the same rows and end with a row's letter, so that none
        begins another: their order is settled whatever follows.
        """
        order = sorted(self.paths.values(), key=lambda p: p.weight & (1 << TOP) - 1)
        for rank, path in enumerate(order, 1):
            path.before = (path.before, _digits(path.weight, path.used))
            path.weight, path.used = (path.weight >> TOP << TOP) + (rank << BITS * (WIDTH - 1)), 1

    def done(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best path whose roles are whole."""
        ends = {s: x for s, x in self._inserted().items() if s in (START, ASSISTANT)}
        state = min(ends, key=lambda s: ends[s][0])
        weight, used, origin, inserts = ends[state]
        path, parts = self.paths[origin], [_digits(weight, used)]
        before = path.before
        while before is not None:
            before, letters = before
            parts.append(letters)
        digest = self._said(path, origin, inserts, state, None)
        return weight >> TOP, "".join(reversed(parts)), digest.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPORT = [(name, pa.int64()) for name in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]


class _Report:
    """What is said of one conversation while its rows pass."""

    def __init__(self) -> None:
        self.repair, self.faults = Repair(), dict.fromkeys(COUNTS, 0)
        self.low = self.high = self.last = None
        self.turns, self.role = 0, None

    def add(self, row: dict) -> None:
        if row["dropped"]:
            return
        turn, role, text = row["turn"], row["role"], row["text"]
        if turn is not None:
            self.turns += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        if self.role is not None:
            self.faults["illegal"] += self.role + role[:1] not in LEGAL
        self.role = role[:1]
        spoken = text.rstrip(BLANKS)
        fault = "blank" if not spoken else "duplicate" if row["again"] else (
            "truncated" if spoken[-1] not in ".!?" else None)
        if fault:
            self.faults[fault] += 1
        self.repair.push(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self, conv: object) -> dict:
        cost, audit, digest = self.repair.done()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": conv, **self.faults, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _streamed(rows: Iterable[dict], start: Callable, finish: Callable) -> Iterator[dict]:
    """Feeds rows that come conversation by conversation to one object each."""
    now, current = None, None
    for row in rows:
        if current is None or row["conv"] != now:
            if current is not None:
                yield from finish(current, now)
            now, current = row["conv"], start(row)
        current.add(row)
    if current is not None:
        yield from finish(current, now)


def _packed(found: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for row in found:
        rows.append(row)
        if len(rows) == size:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    yield pa.RecordBatch.from_pylist(rows, schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from batch.slice(at, 500).to_pylist()


def in_order(conversations: DataFrame, conv: str, turn: str, role: str, text: str, dropped: Column | None) -> DataFrame:
    """Rows of a conversation together and by turn (nulls first, then role and text), equal ones marked.

    One shuffle: the window over equal turns and the sort both use the placing by
    conversation. A null role or text reads as one space.
    """
    spaced = lambda name: F.coalesce(F.col(name), F.lit(" "))
    rows = conversations.select(
        F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"),
        spaced(text).alias("text"), (F.lit(False) if dropped is None else dropped).alias("dropped"))
    by_conv = rows.repartition("conv")
    hashes = [F.xxhash64(F.lit(n), "role", F.lit("\n"), "text") for n in (1, 2)]
    equal = Window.partitionBy("conv", "h1", "h2").orderBy(F.col("dropped"), F.col("turn").asc_nulls_first())
    marked = by_conv.withColumns({"h1": hashes[0], "h2": hashes[1]}).withColumn("again", F.row_number().over(equal) > 1)
    return marked.drop("h1", "h2").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")


def repaired(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    dropped: Column | None = None,
) -> DataFrame:
    """Faults and cheapest repair of every conversation: ``conv_id, gaps, blank, ... cost, audit, repaired_sha256``.

    Rows are taken by turn, nulls first, ties by role and text. A blank row and a
    row whose role and text came before have to be deleted (2), one that does not
    end with a sentence mark costs 5 unless it is; keeping is free, another role
    costs 1, an inserted turn 5. What is left has to read system (or not), then
    user and assistant in turn, or be empty. Of equally cheap audits the least in
    ASCII order is taken.

    Rows pass as a stream, sorted by Spark, which spills; a task holds four paths
    and the letters of the conversation it is in, however long that is. Null ids
    form one conversation, an empty role cannot be kept, rows marked ``dropped``
    only keep their conversation in the result, other columns are not read. An
    empty table gives an empty one.
    """
    rows = in_order(conversations, conv, turn, role, text, dropped)
    kind = rows.schema["conv"].dataType
    names = ["conv", *[n for n, _ in _REPORT]]
    types = [kind, *[T.StringType() if n in ("audit", "repaired_sha256") else T.LongType() for n, _ in _REPORT]]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)])

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal arrow
            for batch in batches:
                arrow = arrow or pa.schema([("conv", batch.schema.field("conv").type), *_REPORT])
                yield batch

        found = _streamed(_each(seen()), lambda _: _Report(), lambda report, key: [report.row(key)])
        first = next(found, None)
        if first is not None:
            yield from _packed((x for part in ([first], found) for x in part), arrow)

    return rows.mapInArrow(reported, schema).select(F.col("conv.id").alias("conv_id"), *names[1:])


class _Applied:
    """Follows an audit through the rows of its conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.out = audit, 0, START, []

    def _emit(self, role: str, text: str, edit: str) -> None:
        self.state = SYSTEM if self.state == START and role[:1] == "s" else NEXT[self.state]
        self.out.append((role, text, edit))

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._emit(ROLES[NEXT[self.state]], "", "I")

    def add(self, row: dict) -> None:
        if row["dropped"]:
            return
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            self._emit(row["role"] if edit == "K" else ROLES[NEXT[self.state]], row["text"], edit)


def repaired_turns(
    conversations: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", dropped: Column | None = None,
) -> DataFrame:
    """The turns that the audits of :func:`repaired` leave: ``conv_id, place, role, text, edit`` (K, R or I)."""
    audits = report.select(F.struct(F.col("conv_id").alias("id")).alias("conv"), "audit")
    rows = in_order(conversations, conv, turn, role, text, dropped).join(audits, "conv").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "text")
    schema = T.StructType([
        T.StructField("conv", rows.schema["conv"].dataType), T.StructField("place", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("role", "text", "edit")]])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, follow, place = None, None, 0
        for batch in batches:
            arrow = pa.schema([("conv", batch.schema.field("conv").type), ("place", pa.int64()), ("role", pa.string()),
                               ("text", pa.string()), ("edit", pa.string())])
            found = []

            def flush() -> None:
                nonlocal place
                for said in follow.out:
                    found.append({"conv": now, "place": place, **dict(zip(("role", "text", "edit"), said, strict=True))})
                    place += 1
                follow.out.clear()

            for row in _each([batch]):
                if follow is None or row["conv"] != now:
                    if follow is not None:
                        follow.inserts()
                        flush()
                    now, follow, place = row["conv"], _Applied(row["audit"]), 0
                follow.add(row)
                flush()
            yield pa.RecordBatch.from_pylist(found, arrow)
        if follow is not None:
            follow.inserts()
            found = []
            flush()
            yield pa.RecordBatch.from_pylist(found, arrow)

    return rows.mapInArrow(followed, schema).select(F.col("conv.id").alias("conv_id"), "place", "role", "text", "edit")
