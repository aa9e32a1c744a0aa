"""Hard-negative mining against brute force over all pairs, with exact whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label string, rank int, part int, windows int"


def brute(rows, is_anchor, positives=5, count=5, low=80):
    fit = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit[i, label, tuple(min(max(math.floor(256.0 * x), -2**63), 2**63 - 1) for x in v)] = None
    out = []
    for i, label, v in fit:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fit if j != i]
        own = sorted((s, j) for s, j, other in scored if other == label)[:positives]
        others = sorted((s, j) for s, j, other in scored if other != label)
        for s, j in own:
            hits = [(t, k) for t, k in others if low * -s <= 100 * -t <= 100 * -s][:count]
            out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(hits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(frame, F.col("vec_id") % 10 == 0, **options).collect())


def test_lists_equal_brute_force(spark, monkeypatch):
    random.seed(4)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(4, 24))
    rows = [(n, (centers[n % 4] * (n % 3) + rng.normal(size=24) * 0.6).tolist(), "abcd"[random.randrange(4)]) for n in range(420)]
    hot = rows[7][1]
    rows += [(1000 + n, hot, "abca"[n % 4]) for n in range(200)]  # one vector under several labels
    rows += [rows[20], rows[20], (3000, [], "a"), (3010, [1.0, 2.0], "b"), (3020, [0.0] * 24, "c"), (3030, hot, "alone")]
    rows += [(None, hot, "a"), (3040, None, "a"), (3050, hot, None), (3060, [None] * 24, "a"), (3070, [float("nan")], "b"),
             (3080, [float("inf")], "b"), (3090, [-x for x in hot], "lone"), (3100, [-x for x in hot], "lone")]
    want = brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want and len(want) > 500
    monkeypatch.setattr(negatives, "CANDIDATES", 32)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    assert mined(spark, rows, positives=3, negatives=7, low=50) == brute(rows, lambda i: i % 10 == 0, 3, 7, 50)


def test_large_numbers_and_empty_tables(spark):
    rows = [(n, [float(n % 5) * 1e12, 1e11 * (n % 7), 3.0], "ab"[n % 2]) for n in range(60)]
    got = mined(spark, rows)
    cut = 2**63 - 1
    assert got and all(s <= cut for r in got for s in r[4:])
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], "a")]) == []


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_bounds_drop_no_pair_and_leave_dimensions_out(spread):
    rng = np.random.default_rng(1)
    shape = rng.normal(size=48) * np.exp(-spread * np.arange(48) / 4)
    a = np.floor(256 * rng.normal(size=(40, 48)) * shape).astype(np.int64)
    c = np.floor(256 * rng.normal(size=(300, 48)) * shape * rng.uniform(0.1, 1, size=(300, 1))).astype(np.int64)
    whole = a @ c.T
    wanted = rng.random((40, 300)) < 0.7
    for share in (0.9, 0.99, 0.0):
        least = np.quantile(whole, share, axis=1).astype(np.int64)
        i, j, s = negatives.pairs_above(a, c, least, wanted)
        want = {(x, y) for x, y in zip(*np.nonzero(wanted & (whole >= least[:, None])))}
        assert set(zip(i, j)) == want and (whole[i, j] == s).all()
