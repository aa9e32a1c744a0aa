"""The mixed reward on hand-made rollouts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rewardloom.config import EngineConfig
from rewardloom.operators.knn import knn_edges
from rewardloom.plans import mixed_reward as mixed
from rewardloom.plans.mixed_reward import FEATURES, GraphMemory, graph_memory, mixed_reward, prompt_table
from rewardloom.session import scratch_folder
from rewardloom.streaming import scoring


def run(spark, rows, gt, vectors, **options):
    rollouts = spark.createDataFrame(
        [(s, q, r, text, truth, json.dumps(extra) if extra is not None else None, b) for s, q, r, text, truth, extra, b in rows],
        "data_source string, query_id bigint, resp_idx bigint, response string, ground_truth string, extra_info string, batch_id bigint")
    ids = spark.createDataFrame(gt, "dataset string, identifier string")
    nodes = spark.createDataFrame(vectors, "query_id bigint, data_source string, embedding array<double>")
    out = mixed_reward(rollouts, ids, nodes, **options).collect()
    return {(r["query_id"], r["resp_idx"]): (r["reward_source"], r["reward"], r["prob"]) for r in out}


def math_rows(query, answers, truth="1", batch=0, source="gsm8k", **extra):
    return [(source, query, i, f"#### {a}", truth, {"index": query, **extra}, batch) for i, a in enumerate(answers)]


VECTORS = [(1, "gsm8k", [1.0, 0.0]), (2, "gsm8k", [0.9, 0.1]), (3, "gsm8k", [0.0, 1.0]), (4, "gsm8k", [-1.0, -0.1])]


def test_labelled_neighbours_decide(spark):
    rows = math_rows(1, ["1", "1", "7"]) + math_rows(2, ["1", "1", "9"], truth="1")
    got = run(spark, rows, [("gsm8k", "1")], VECTORS)
    assert {got[1, i][0] for i in range(3)} == {"gt"}
    assert [got[1, i][1] for i in range(3)] == [1.0, 1.0, 0.0]
    assert {got[2, i][0] for i in range(3)} == {"graph"}
    assert got[2, 0][1] == 1.0 and got[2, 0][2] > got[2, 2][2]


def test_no_memory_falls_back_to_ground_truth(spark):
    rows = math_rows(1, ["1", "2"]) + math_rows(2, ["1"])
    got = run(spark, rows, [], VECTORS)
    assert {v[0] for v in got.values()} == {"gt_fallback"}
    assert [got[1, 0][1], got[1, 1][1], got[2, 0][1]] == [1.0, 0.0, 1.0]


def test_opposite_neighbours_have_no_say(spark):
    rows = math_rows(1, ["1"]) + math_rows(4, ["1", "3"])
    got = run(spark, rows, [("gsm8k", "1")], VECTORS)
    assert got[4, 0][:2] == ("gt_fallback", 1.0) and got[4, 1][:2] == ("gt_fallback", 0.0)


def test_one_validation_row_gates_its_batch(spark):
    rows = math_rows(1, ["1"], batch=5) + math_rows(2, ["3"], batch=5, is_train=False) + math_rows(3, ["1"], batch=6)
    got = run(spark, rows, [("gsm8k", "1")], VECTORS)
    assert got[1, 0][0] == got[2, 0][0] == "validation"
    assert got[3, 0][0] == "gt_fallback"


@pytest.mark.parametrize("published, source", [(True, "graph"), (False, "gt")])
def test_sets_outside_the_published_families(spark, published, source):
    rows = math_rows(1, ["1"]) + [("siqa", 2, 0, "#### A", "A", {"index": 2}, 0)]
    vectors = VECTORS[:1] + [(2, "siqa", [0.9, 0.1])]
    got = run(spark, rows, [("gsm8k", "1"), ("siqa", "2")], vectors, reference_families=published)
    assert got[2, 0][0] == source


def test_equal_questions_form_one_group(spark):
    rows = math_rows(1, ["1"], question="same") + math_rows(2, ["1"], question="same")
    got = run(spark, rows, [("gsm8k", "1")], VECTORS)
    assert got[1, 0][0] == got[2, 0][0] == "gt"


def test_missing_extra_info(spark):
    rows = [("gsm8k", 1, 0, "#### 1", "1", None, 0)]
    assert run(spark, rows, [("gsm8k", "1")], VECTORS)[1, 0][0] == "gt_fallback"


def test_given_memory_and_domain_filter(spark):
    plain = [0.0] * (FEATURES - 3)
    memory = GraphMemory(
        spark.createDataFrame([(90, [0.6, 0.8, 0.0, *plain], 1.0), (91, [0.0] * FEATURES, 0.0)],
                              "query_id bigint, features array<double>, reward double"),
        spark.createDataFrame([(90, "math", [1.0, 0.0]), (91, "qa", [1.0, 0.0])],
                              "id bigint, domain string, embedding array<double>"))
    rows = math_rows(2, ["5"])
    free = run(spark, rows, [], VECTORS, memory=memory)
    kept = run(spark, rows, [], VECTORS, memory=memory, config=EngineConfig(domain_filter=True))
    assert kept[2, 0] == ("graph", 1.0, 1.0) and free[2, 0][2] < 1.0


def qa_rows(query, answers, batch=0):
    return [("arc_c", query, i, f"Because of {a}. #### {a}", "A", {"index": query}, batch) for i, a in enumerate(answers)]


def test_answers_of_one_question_get_their_own_probability(spark):
    vectors = [(1, "arc_c", [1.0, 0.0]), (2, "arc_c", [0.9, 0.1])]
    got = run(spark, qa_rows(1, "AAB") + qa_rows(2, "AB"), [("arc_c", "1")], vectors)
    assert {got[2, i][0] for i in range(2)} == {"graph"}
    assert got[2, 0][2] > got[2, 1][2]


def test_features_and_edges_can_be_replaced(spark):
    rows = math_rows(1, ["1", "7"]) + math_rows(2, ["1"])
    nothing = run(spark, rows, [("gsm8k", "1")], VECTORS, connect=lambda new, known, k, **_: knn_edges(new, known, k).limit(0))
    assert nothing[2, 0][0] == "gt_fallback"
    longer = run(spark, rows, [("gsm8k", "1")], VECTORS, describe=lambda r: F.array(F.length(r).cast("double")), described=1)
    assert longer[2, 0][0] == "graph"


def test_static_memory_makes_batches_independent(spark):
    rows = [r for q in range(1, 5) for r in math_rows(q, ["1", "2", "1"], batch=q)]
    rollouts = spark.createDataFrame(
        [(s, q, r, t, g, json.dumps(e), b) for s, q, r, t, g, e, b in rows],
        "data_source string, query_id bigint, resp_idx bigint, response string, ground_truth string, extra_info string, batch_id bigint")
    ids = spark.createDataFrame([("gsm8k", "1"), ("gsm8k", "3")], "dataset string, identifier string")
    nodes = spark.createDataFrame(VECTORS, "query_id bigint, data_source string, embedding array<double>")
    memory = graph_memory(rollouts, ids, nodes)
    whole = {tuple(r) for r in mixed_reward(rollouts, ids, nodes).collect()}
    assert {tuple(r) for r in mixed_reward(rollouts, ids, nodes, memory=memory).collect()} == whole
    parts = [mixed_reward(rollouts.where(F.col("batch_id") == b), ids, nodes, memory=memory).collect() for b in range(1, 5)]
    assert {tuple(r) for part in parts for r in part} == whole


def test_one_prompt_with_a_third_of_all_rows(spark):
    rows = math_rows(1, ["1"] * 200 + ["2"] * 100) + [r for q in (2, 3) for r in math_rows(q, ["1"] * 150 + ["4"] * 150)]
    got = run(spark, rows, [("gsm8k", "1")], VECTORS)
    assert len(got) == 900
    assert sum(v[1] for k, v in got.items() if k[0] == 1) == 200


def test_equal_vectors_search_once(spark):
    vectors = [VECTORS[0], *[(q, "gsm8k", [0.9, 0.1]) for q in (2, 3, 4)], (5, "gsm8k", [0.5, 0.5])]
    rows = [r for q in range(1, 6) for r in math_rows(q, ["1", "7"])]
    searched = []

    def connect(new, known, k, **options):
        searched.extend(r["id"] for r in new.collect())
        return knn_edges(new, known, k, **options)

    got = run(spark, rows, [("gsm8k", "1")], vectors, connect=connect)
    assert sorted(searched) == [2, 5]
    assert got[2, 0] == got[3, 0] == got[4, 0] and got[2, 0][0] == got[5, 0][0] == "graph"


def test_second_vector_of_one_query_stays_its_own(spark):
    known = [(1, "gsm8k", [1.0, 0.0]), (4, "gsm8k", [0.0, 1.0])]
    alone = [*known, *[(q, "gsm8k", [0.9, 0.1]) for q in (2, 3)]]
    rows = math_rows(1, ["1", "1"]) + math_rows(4, ["7", "1"]) + math_rows(2, ["1", "7"]) + math_rows(3, ["1", "7"])
    gt = [("gsm8k", "1"), ("gsm8k", "4")]
    plain = run(spark, rows, gt, alone)
    more = run(spark, rows, gt, [*alone, (2, "gsm8k", [0.1, 0.9])])
    assert [more[3, i] for i in range(2)] == [plain[3, i] for i in range(2)]
    assert more[2, 0][2] != plain[2, 0][2]


def test_gate_reads_the_rollouts_not_the_votes(spark):
    scored = spark.createDataFrame(
        [(0, "a", 1, 1, "gsm8k", "1", None, True, 1.0), (0, "b", 2, 1, "gsm8k", "2", None, False, 2.0), (1, "c", 3, 1, "gsm8k", "3", None, True, 1.0)],
        "batch_id bigint, prompt_key string, query_id bigint, resp_idx bigint, data_source string, index string, problem_id string, is_train boolean, answer double")
    prompts = prompt_table(scored, spark.createDataFrame([("gsm8k", "3")], "dataset string, identifier string"))
    assert {r["prompt_key"]: r["route"] for r in prompts.collect()} == {"a": "validation", "b": "validation", "c": "gt"}
    plan = prompts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [batch_id") == 4  # votes, answers, prompts, and the batches of the gate


def test_batches_of_a_stream_search_a_vector_once(spark, monkeypatch):
    """Each micro-batch once keyed all vectors, summed the whole memory and searched all its vectors again."""
    vectors = [(q, "gsm8k", [1.0, 0.1 * (q % 3)]) for q in range(1, 10)]
    rows = [r for q in range(1, 10) for r in math_rows(q, ["1", "2", "1"], batch=q % 4)]
    rollouts = spark.createDataFrame(
        [(s, q, r, t, g, json.dumps(e), b) for s, q, r, t, g, e, b in rows],
        "data_source string, query_id bigint, resp_idx bigint, response string, ground_truth string, extra_info string, batch_id bigint")
    ids = spark.createDataFrame([("gsm8k", "1"), ("gsm8k", "2")], "dataset string, identifier string")
    nodes = spark.createDataFrame(vectors, "query_id bigint, data_source string, embedding array<double>")
    memory = graph_memory(rollouts, ids, nodes)
    whole = {tuple(r) for r in mixed_reward(rollouts, ids, nodes, memory=memory).collect()}
    searched, find = [], mixed._nodes

    def nodes_of(first, distinct):
        searched.extend(r["id"] for r in first.collect())
        return find(first, distinct)

    monkeypatch.setattr(mixed, "_nodes", nodes_of)
    folder = scoring.new_folder(rollouts, "batches")
    score = scoring.mixed_batches(ids, nodes, folder, memory)
    for batch in [0, 1, 2, 2, 3]:  # one of them again, as after a failure
        score(rollouts.where(F.col("batch_id") == batch), batch)
    found = spark.read.parquet(folder).drop("batch")
    assert {tuple(r) for r in found.collect()} == whole and found.count() == 27
    assert len(searched) == 3 and {q % 3 for q in searched} == {0, 1, 2}


def test_batches_without_a_known_vector(spark):
    rows = spark.createDataFrame([("gsm8k", q, 0, "#### 1", "1", json.dumps({"index": q}), q) for q in (7, 8)],
        "data_source string, query_id bigint, resp_idx bigint, response string, ground_truth string, extra_info string, batch_id bigint")
    ids = spark.createDataFrame([("gsm8k", "1")], "dataset string, identifier string")
    nodes = spark.createDataFrame(VECTORS, "query_id bigint, data_source string, embedding array<double>")
    folder = scoring.new_folder(rows, "batches")
    score = scoring.mixed_batches(ids, nodes, folder, graph_memory(rows, ids, nodes))
    for batch in (7, 8):
        score(rows.where(F.col("batch_id") == batch), batch)
    assert {r["reward_source"] for r in spark.read.parquet(folder).collect()} == {"gt_fallback"}


@pytest.mark.parametrize("given", [False, True])
def test_result_leaves_two_tables(spark, given):
    """Scored rollouts, prompts and vectors once stayed on disk beside all shuffles until the result was written."""
    rows = [r for q in range(1, 4) for r in math_rows(q, ["1", "7"])]
    rollouts = spark.createDataFrame(
        [(s, q, r, t, g, json.dumps(e), b) for s, q, r, t, g, e, b in rows],
        "data_source string, query_id bigint, resp_idx bigint, response string, ground_truth string, extra_info string, batch_id bigint")
    ids = spark.createDataFrame([("gsm8k", "1")], "dataset string, identifier string")
    nodes = spark.createDataFrame(VECTORS, "query_id bigint, data_source string, embedding array<double>")
    memory = graph_memory(rollouts, ids, nodes) if given else None
    with scratch_folder(spark) as folder:
        result = mixed_reward(rollouts, ids, nodes, memory=memory)
        tables = os.listdir(folder.removeprefix("file:"))
        assert sorted(name.split("-")[0] for name in tables) == ["placed", "sums"]
        found = {(r["query_id"], r["resp_idx"]): tuple(r)[3:] for r in result.collect()}
    assert found == {k: (v[1], v[0], v[2]) for k, v in run(spark, rows, [("gsm8k", "1")], VECTORS).items()}
