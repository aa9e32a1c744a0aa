"""Fitted and given models: gradients by differences, a plain forward pass, dense solves, foreign scorers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.operators import attention, external, ingest, ranking_fit, spreading
from rewardloom.plans.catalog import QUERIES


def plain_loss(x, y, groups, train, w, b, weight, margin=0.5, share=0.5):
    s = x @ w + b
    own = weight * y * np.log1p(np.exp(-s)) + (1 - y) * np.log1p(np.exp(s))
    lacks = [max(0.0, margin - (s[p] - s[n])) for p in range(len(y)) for n in range(len(y))
             if groups[p] == groups[n] and train[p] and train[n] and y[p] > 0.5 and y[n] <= 0.5]
    return own[train].mean() + share * sum(lacks) / max(1, len(lacks))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0).astype(float)
    groups = rng.integers(0, 9, 120)
    train = groups != 4
    rows = [(int(n), int(g), r.tolist(), float(v), bool(t)) for n, (g, r, v, t) in enumerate(zip(groups, x, y, train))]
    frame = spark.createDataFrame(rows, "id long, query_id long, features array<double>, reward double, is_train boolean")
    return frame, x, y, groups, train


def test_gradient_equals_finite_differences(labelled):
    frame, x, y, groups, train = labelled
    rows = frame.select("query_id", F.col("features").alias("x"), "reward", F.col("is_train").alias("counts"))
    pairs = sum(int((y[train & (groups == g)] > 0.5).sum() * (y[train & (groups == g)] <= 0.5).sum()) for g in set(groups))
    balance = (y[train] <= 0.5).sum() / (y[train] > 0.5).sum()
    task = ranking_fit._Task(rows, pairs, int(train.sum()), float(balance))
    w, b = np.array([0.3, -0.2, 0.1]), 0.05
    at = ranking_fit._step(task, w, b, "query_id", ranking_fit.RankingOptions())
    loss = lambda w, b: plain_loss(x, y, groups, train, w, b, balance)
    assert at["loss"] == pytest.approx(loss(w, b), abs=1e-9)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert at["gradient"][k] == pytest.approx((loss(w + step, b) - loss(w - step, b)) / 2e-6, abs=1e-5)
    assert at["bias"] == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-5)


def test_fit_lowers_the_loss_and_ranks(labelled):
    frame, x, y, groups, train = labelled
    model = ranking_fit.fit_ranked_rewards(frame, options=ranking_fit.RankingOptions(epochs=12, rate=0.2))
    assert model.losses[-1] < 0.8 * model.losses[0] and model.best_metric > 0.7 and model.best_epoch > 0
    rows = ranking_fit.predict_ranked(model, frame).collect()
    assert len(rows) == 120
    assert np.mean([r.predicted == r.reward for r in rows]) > 0.75
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0, ddof=1)
    want = 1 / (1 + np.exp(-(z @ np.array(model.weights) + model.bias)))
    assert all(r.prob == pytest.approx(want[r.id], abs=1e-9) for r in rows)


def test_steps_shuffle_no_features(labelled, capsys):
    frame = labelled[0].select("query_id", F.col("features").alias("x"), "reward", F.col("is_train").alias("counts"), F.lit(0.0).alias("score"))
    placed = frame.repartition("query_id").persist()
    placed.count()
    ranking_fit.ranking_terms(placed, "query_id", 0.5).explain()
    plan = capsys.readouterr().out.split("InMemoryRelation")[0]
    assert "Window" in plan and "Exchange" not in plan
    placed.unpersist()


def test_fit_without_training_rows(spark, labelled):
    model = ranking_fit.fit_ranked_rewards(labelled[0].limit(0))
    assert model.weights == () and [r.prob for r in ranking_fit.predict_ranked(model, labelled[0].limit(2)).collect()] == [0.5, 0.5]
    odd = spark.createDataFrame([(None, [1.0], 1.0, True), (1, None, 1.0, True), (1, [2.0], None, True)],
                                "query_id long, features array<double>, reward double, is_train boolean")
    assert ranking_fit.fit_ranked_rewards(odd).weights == ()


def forward(vectors, edges, weights, loops_for):
    """The layer over dictionaries."""
    parts = {}
    for kind, own in weights.items():
        ends = [(s, d) for s, d, k in edges if k == kind and s in vectors and d in vectors]
        if kind == loops_for:
            ends = [(s, d) for s, d in ends if s != d] + [(n, n) for n in vectors]
        heads, width = own.attention.shape
        for dst in {d for _, d in ends}:
            sources = [s for s, d in ends if d == dst]
            sent = np.array([vectors[s] @ own.source for s in sources]).reshape(len(sources), heads, width)
            both = sent + (vectors[dst] @ own.target).reshape(heads, width)
            logit = (np.where(both > 0, both, 0.2 * both) * own.attention).sum(axis=2)
            share = np.exp(logit - logit.max(axis=0))
            share /= share.sum(axis=0)
            parts.setdefault(dst, []).append((share[:, :, None] * sent).sum(axis=0).reshape(-1) + own.bias)
    return {n: np.maximum(np.mean(p, axis=0), 0) for n, p in parts.items()}


def test_attention_equals_a_forward_pass(spark):
    rng = np.random.default_rng(8)
    vectors = {f"n{k}": rng.normal(size=6) * 3 for k in range(30)}
    kinds = ["similar_to", "leads_to", "unused"]
    edges = [(f"n{rng.integers(30)}", f"n{rng.integers(31)}", kinds[rng.integers(3)]) for _ in range(150)]
    edges += [(f"n{k}", "n0", "leads_to") for k in range(30)]  # a target all nodes point to
    make = lambda inputs: attention.EdgeWeights(
        rng.normal(size=(inputs, 8)), rng.normal(size=(inputs, 8)), rng.normal(size=(4, 2)), rng.normal(size=8))
    layers = [{k: make(inputs) for k in kinds[:2]} for inputs in (6, 8)]
    nodes = spark.createDataFrame([(n, v.tolist()) for n, v in vectors.items()], "id string, vec array<double>")
    frame = spark.createDataFrame(edges, "src string, dst string, edge_type string")
    want = forward(forward(vectors, edges, layers[0], "similar_to"), edges, layers[1], "similar_to")
    got = {r.id: np.array(r.vec) for r in attention.attention_stack(nodes, frame, layers).collect()}
    assert set(got) == set(want) and all(np.allclose(got[n], want[n], atol=1e-9) for n in want)
    assert attention.attention_layer(nodes.limit(0), frame.limit(0), layers[0]).count() == 0


def test_spreading_equals_a_dense_solve(spark):
    rng = np.random.default_rng(2)
    size, damping, prior = 500, 0.6, 0.4
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(
        rng.integers(0, size, 3000), rng.integers(0, size - 5, 3000), rng.uniform(-0.1, 1, 3000))]
    reward = {n: float(n % 2) for n in range(0, size, 7)}
    shares = np.zeros((size, size))
    for a, b, w in edges:
        shares[b, a] += max(w, 0)
    totals = shares.sum(axis=1, keepdims=True)
    shares = np.divide(shares, totals, out=np.zeros_like(shares), where=totals > 0)
    matrix, right = np.eye(size), np.full(size, prior)
    for n in range(size):
        if n in reward:
            right[n] = reward[n]
        elif totals[n] > 0:
            matrix[n] -= damping * shares[n]
            right[n] = (1 - damping) * prior
    want = np.linalg.solve(matrix, right)
    nodes = spark.createDataFrame([(n, reward.get(n)) for n in range(size)], "id long, reward double")
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    got, rounds, change = spreading.spread_rewards(nodes, frame, damping, prior, tolerance=1e-7)
    rows = got.collect()
    assert len(rows) == size and change <= 1e-7 and rounds <= math.ceil(math.log(1e-7) / math.log(damping)) + 1
    assert max(abs(r.value - want[r.id]) for r in rows) < 1e-6
    assert all(r.value == r.reward for r in rows if r.reward is not None)
    none, rounds, _ = spreading.spread_rewards(nodes, frame.limit(0))
    assert rounds == 1 and none.where("reward is null and value <> 0.5").count() == 0
    assert spreading.spread_rewards(nodes.limit(0), frame)[0].count() == 0
    with pytest.raises(ValueError):
        spreading.spread_rewards(nodes, frame, damping=1.0)


ROWS = "batch string, prompt string, resp_idx long, data_source string, response string, ground_truth string, extra_info string"


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [("b", f"p{k % 40}" if k % 40 else None, k, "math", f"answer {k % 3}", "answer 1", None) for k in range(400)]
    return spark.createDataFrame(rows, ROWS)


def test_scorers_see_whole_groups(prompts):
    def group_sizes(sources, responses, truths, infos):
        return [len(responses)] * len(responses)

    group = [F.col("batch"), F.col("prompt")]
    one_each = external.external_reward(prompts, group_sizes, group, call_rows=1).collect()
    assert len(one_each) == 400 and {r.reward for r in one_each} == {10.0}
    many = external.external_reward(prompts, group_sizes, group, call_rows=35).collect()
    assert {r.reward for r in many} <= {10.0, 20.0, 30.0} and max(r.reward for r in many) > 10
    null = [r for r in one_each if r.group_key["k1"] is None]
    assert len(null) == 10


def test_scorers_that_fail(prompts):
    def broken(sources, responses, truths, infos):
        if responses[0] == "answer 0":
            raise KeyError("x")
        return [1.0] * (len(responses) - 1) if responses[0] == "answer 1" else [None, "2", *["no number"] * (len(responses) - 2)]

    rows = external.external_reward(prompts, broken, [F.col("prompt")], call_rows=1).collect()
    assert len(rows) == 400 and all(r.reward is None for r in rows)
    assert {r.error.split(":")[0] for r in rows} == {"KeyError", "ValueError"}
    large = external.external_reward(prompts, lambda *a: [0.5] * len(a[0]), [F.lit(1)], most_rows=399).collect()
    assert {(r.reward, r.error) for r in large} == {(None, "group too large")}
    assert external.external_reward(prompts.limit(0), broken, [F.col("prompt")]).count() == 0


def test_encoded_texts_are_unit_vectors(spark):
    rows = [(0, "a b c"), (1, "a b c"), (2, "A, b; c!"), (3, None), (4, ""), (5, "b d"), (6, "x y z w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in ingest.encode_text(frame, "text", 32).collect()}
    assert got[0] == got[1] == got[2] and not any(got[3]) and not any(got[4])
    assert all(sum(x * x for x in got[k]) == pytest.approx(1) for k in (0, 5, 6))
    plain = {r.doc_id: r.embedding for r in ingest.encode_text(frame, "text", 32, idf=False).collect()}
    assert plain[5] != got[5]  # rare words weigh more


def test_fitted_rewards_tell_successes_from_failures(spark, root):
    rows = QUERIES["prp6_fitted_rewards"](spark, root).collect()
    memory = [r for r in rows if r.is_memory]
    mean = lambda reward: np.mean([r.prob for r in memory if r.reward == reward])
    assert len(rows) == 1000 and mean(1.0) > mean(0.0) and all(r.predicted == float(r.prob > 0.5) for r in rows if abs(r.prob - 0.5) > 1e-6)
