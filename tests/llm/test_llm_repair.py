"""Conversation structure repair against a plain dynamic programme over (cost, audit) pairs."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rewardloom.llm import queries, repair

BLANKS = " \t\n\x0b\x0c\r"
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute(rows):
    """(cost, audit, digest) of rows (role, text, fault), from the end: the least pair for each state."""
    best = [{} for _ in range(len(rows) + 1)]
    for at in range(len(rows), -1, -1):
        ends = {}
        for state in ("", "s", "u", "a"):
            found = []
            if at == len(rows):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                role, text, fault = rows[at]
                after = best[at + 1]
                extra = 5 if fault == "truncated" else 0

                def go(cost, letter, to, said):
                    if to in after:
                        c, a, t = after[to]
                        found.append((cost + c, letter + a, said + t))

                go(2, "D", state, ())
                if fault not in ("blank", "duplicate"):
                    if role[:1] == FOLLOWS[state]:
                        go(extra, "K", role[:1], (f"{role}:{text}",))
                    if state == "" and role[:1] == "s":
                        go(extra, "K", "s", (f"{role}:{text}",))
                    go(1 + extra, "R", FOLLOWS[state], (f"{NAMES[FOLLOWS[state]]}:{text}",))
            if found:
                ends[state] = min(found)
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                to = FOLLOWS[state]
                if to in ends:
                    cost, audit, said = ends[to]
                    offer = (5 + cost, "I" + audit, (f"{NAMES[to]}:", *said))
                    ends[state] = min(ends.get(state, offer), offer)
        best[at] = ends
    cost, audit, said = best[0][""]
    return cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def faults(rows):
    """Rows (turn, role, text) with their first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        spoken = text.rstrip(BLANKS)
        out.append("blank" if not spoken else "duplicate" if (role, text) in seen else
                   "truncated" if spoken[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, digest = brute([(r, t, f) for (_, r, t), f in zip(rows, found, strict=True)])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


def report(frame, **options):
    return {r.conv_id: tuple(r)[1:] for r in repair.repaired(frame, **options).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_repairs_equal_brute_force(spark, seed):
    random.seed(seed)
    rows = []
    for conv in range(150):
        for turn in range(random.choice([1, 2, 3, 5, 9, 14])):
            role = random.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "sys"])
            text = random.choice(["a.", "b!", "c?", "", " \t", "cut", "d.  ", f"own {turn}.", f"own {turn}"])
            rows.append((conv, random.choice([turn, turn, None, turn * 2]), role, text))
    got = report(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    assert got == {conv: expected(rest) for conv, rest in by.items()}


def test_long_conversations_pass_many_blocks(spark):
    random.seed(7)
    rows = [(1, n, random.choice(["user", "assistant", "system", "x"]),
             random.choice(["", "cut", "z.", f"own {n}.", f"own {n}"])) for n in range(1200)]
    rows += [(2, n, "user", f"same role {n}.") for n in range(400)]
    rows += [(3, n, "assistant", f"tie {n}") for n in range(260)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = report(frame)
    for conv in (1, 2, 3):
        assert got[conv] == expected([r[1:] for r in rows if r[0] == conv])
    turns = repair.repaired_turns(frame, repair.repaired(frame)).collect()
    for conv in (1, 2, 3):
        said = sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in said] == list(range(len(said)))
        text = "\n".join(f"{r.role}:{r.text}" for r in said)
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][-1]


def test_edges(spark):
    long = "word " * 200000 + "end."
    rows = [
        (None, 0, "user", "a."), (None, None, "assistant", "b."), (1, None, None, None), (2, 0, "user", long),
        (2, 1, "assistant", "b."), (2, 1, "assistant", "b."), (3, 0, "user", ""), (4, 0, "system", "rules."), (5, 0, "", "x."),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", conv int, audit int")
    got = report(frame)
    none = hashlib.sha256(b"").hexdigest()
    assert got[None] == expected([r[1:] for r in rows if r[0] is None])
    assert got[1] == (0, 1, 0, 0, 0, 2, "D", none) and got[3] == (0, 1, 0, 0, 0, 2, "D", none)
    assert got[2][:7] == (0, 0, 1, 0, 1, 2, "KKD")
    assert got[4][-3:] == (2, "D", none) and got[5][-3:] == (2, "D", none)
    assert repair.repaired(frame.limit(0)).count() == 0
    gone = report(frame, dropped=F.lit(True))
    assert gone == {k: (0, 0, 0, 0, 0, 0, "", none) for k in got}
    assert repair.repaired_turns(frame, repair.repaired(frame)).filter("conv_id is null").count() == len(
        [x for x in got[None][-2] if x != "D"])


def test_query_equals_brute_force(spark, root):
    by = {}
    for r in queries.table(spark, root, "conversations").collect():
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = r.role or " ", " " if r.text is None else r.text
        rows = by.setdefault(r.conv_id, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        rows += [(r.turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op12_structure_repair(spark, root).collect()}
    assert got == {conv: expected(rows) for conv, rows in by.items()}
    assert sum(x[5] > 0 for x in got.values()) > 5
