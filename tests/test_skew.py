"""Ranks, splits and metrics with one group holding a third of all rows or more."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rewardloom.operators import features, metrics, propagate, ranking, runlog, sampling


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    return [
        ("hot" if i % 3 else f"g{i % 7}", i, round(rnd.random(), 2) if i % 5 else 0.5, float(rnd.random() < 0.4))
        for i in range(1200)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "dataset string, id bigint, prob double, reward double")


def test_shuffled_rank_equals_row_number(table):
    ranked = ranking.shuffled_rank(table, ["dataset"], ["id"])
    window = W.partitionBy("dataset").orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"))), "id")
    wrong = ranked.withColumn("plain", F.row_number().over(window)).where("rank <> plain")
    assert wrong.count() == 0 and ranked.count() == 1200


def test_ordered_rank_equals_row_number(table):
    ranked = ranking.ordered_rank(table, ["dataset"], "prob", ["id"])
    window = W.partitionBy("dataset").orderBy("prob", "id")
    assert ranked.withColumn("plain", F.row_number().over(window)).where("rank <> plain").count() == 0


def test_splits_are_disjoint_and_complete(table):
    split = sampling.split_by_share(table, ["dataset"], ["id"])
    assert split.count() == split.select("id").distinct().count() == 1200


def test_subsets_nest(table):
    subsets = sampling.nested_subsets(table, ["dataset"], ["id"], [10, 20, 70])
    inner = subsets.where("percent = 10").select("id")
    assert inner.join(subsets.where("percent = 70"), "id", "left_anti").count() == 0


def test_small_groups_keep_one_row(spark):
    tiny = spark.createDataFrame([("a", i) for i in range(7)], "dataset string, id bigint")
    assert sampling.nested_subsets(tiny, ["dataset"], ["id"], [10]).count() == 1
    assert sampling.nested_subsets(tiny, ["dataset"], ["id"], [10], floor_one=False).count() == 0


def auc_by_pairs(rows):
    pos = [r[2] for r in rows if r[3] > 0.5]
    neg = [r[2] for r in rows if r[3] <= 0.5]
    if not pos or not neg:
        return 0.5
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)


def test_auc_matches_pairs(table, rows):
    got = {r["scope"]: r["roc_auc"] for r in metrics.roc_auc(table, "dataset").collect()}
    assert got["overall"] == pytest.approx(auc_by_pairs(rows))
    assert got["hot"] == pytest.approx(auc_by_pairs([r for r in rows if r[0] == "hot"]))


def test_auc_of_reversed_scores(table):
    up = metrics.roc_auc(table, "dataset").withColumnRenamed("roc_auc", "up")
    down = metrics.roc_auc(table.withColumn("prob", 1 - F.col("prob")), "dataset")
    assert up.join(down, "scope").where("abs(up + roc_auc - 1) > 1e-9").count() == 0


def test_single_class_gives_half(table):
    only = table.withColumn("reward", F.lit(1.0))
    assert {r["roc_auc"] for r in metrics.roc_auc(only, "dataset").collect()} == {0.5}


def test_ranking_pairs_match_brute_force(table, rows):
    got = {r["query_id"]: r for r in metrics.ranking_pairs(table, "dataset", "prob").collect()}
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        pairs = [(p[2], n[2]) for p in mine if p[3] > 0.5 for n in mine if n[3] <= 0.5]
        assert got[name]["pairs"] == len(pairs)
        assert got[name]["wrong_pairs"] == sum(n >= p for p, n in pairs)
        assert got[name]["hinge_sum"] == pytest.approx(sum(max(0.0, 0.5 - (p - n)) for p, n in pairs))


def test_ranking_loss_without_pairs(table):
    only = table.withColumn("reward", F.lit(1.0))
    assert metrics.ranking_loss(only, "dataset", "prob").head()["ranking_loss"] == 0.0


def test_consensus_rules(spark):
    def flags(answers, strict=False):
        rows = spark.createDataFrame(
            [("q", i, f"#### {a}") for i, a in enumerate(answers)], "query_id string, resp_idx bigint, response string")
        out = features.answer_features(rows, ["query_id"], F.lit("math"), strict).orderBy("resp_idx")
        return [int(r["answer_features"][2]) for r in out.collect()]

    assert flags([4, 4, 4, 5, 4, 4, 4, 3]) == [1, 1, 1, 0, 1, 1, 1, 0]
    assert flags([0, 0, 5]) == [0, 0, 0]
    assert flags([0, 0, 5], strict=True) == [1, 1, 0]
    assert flags([2, 3]) == [1, 0]


def test_propagation_matches_all_pairs(spark):
    rnd = random.Random(5)
    vec = lambda: [rnd.uniform(-1, 1), rnd.uniform(-1, 1)]
    memory = [(m % 4 if m % 3 else 0, vec(), float(rnd.random() < 0.5)) for m in range(60)]
    new = [(q % 5, i, vec()) for i, q in enumerate(range(40))]
    edges = [(q, m, rnd.uniform(-0.2, 1)) for q in range(4) for m in range(4)]
    unit = lambda v: [x / (v[0] ** 2 + v[1] ** 2) ** 0.5 for x in v]
    memory = [(m, unit(v), r) for m, v, r in memory]
    new = [(q, i, unit(v)) for q, i, v in new]
    out = propagate.propagate(
        spark.createDataFrame(new, "query_id bigint, resp_idx bigint, features array<double>"),
        spark.createDataFrame(memory, "query_id bigint, features array<double>, reward double"),
        spark.createDataFrame(edges, "src bigint, dst bigint, sim double"), 2)
    got = {r["resp_idx"]: r["prob"] for r in out.collect()}
    for q, i, v in new:
        terms = [(max(w, 0) * (1 + v[0] * f[0] + v[1] * f[1]), r) for a, b, w in edges if a == q for m, f, r in memory if m == b]
        total = sum(t for t, _ in terms)
        if total > 0:
            assert got[i] == pytest.approx(sum(t * r for t, r in terms) / total, abs=1e-8)
        else:
            assert got[i] is None


def test_best_step_is_earliest(spark):
    steps = spark.createDataFrame([(41, 0.5), (82, 0.7), (123, 0.7)], "step bigint, avg_score double")
    assert runlog.best_step(steps).head()["best_step"] == 82
    marks = {r["step"]: (r["improves"], r["is_best"]) for r in runlog.best_steps(steps).collect()}
    assert marks == {41: (True, False), 82: (True, True), 123: (False, False)}


def test_early_stopping(spark):
    metric = [0.1, 0.3, 0.2, 0.25, 0.3, 0.9, 0.1]
    history = spark.createDataFrame([(1, i + 1, m) for i, m in enumerate(metric)], "run bigint, epoch bigint, metric double")
    row = runlog.early_stopping(history, "run", 3).head()
    assert (row["best_epoch"], row["total_epochs"], row["best_metric"]) == (2, 5, 0.3)
