"""Files in and out, and streams."""

import json

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import checks
from rewardloom.schema import NODE
from rewardloom.sources import feeds, readers, writers
from rewardloom.streaming import scoring as streams


def test_rollout_json(spark, tmp_path):
    rows = [{"query_idx": 1, "domain": "math", "responses": ["a", "b"], "extra_info": {"answer": "1"}}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    got = readers.read_rollouts(spark, str(tmp_path / "r.json"), multiline=True).orderBy("resp_idx").collect()
    assert [(r["query_id"], r["resp_idx"], r["response"]) for r in got] == [(1, 0, "a"), (1, 1, "b")]


def test_gt_id_file(spark, tmp_path):
    (tmp_path / "ids.json").write_text(json.dumps({
        "GSM8K": {"indices": [1, "2.0", "x"], "n_total": 3}, "mmlu": [5, 5], "strange": [1], "math": "bad"}))
    got = {(r["dataset"], r["identifier"], r["domain"]) for r in readers.read_gt_ids(spark, str(tmp_path / "ids.json"), multiline=True).collect()}
    assert got == {("gsm8k", "1", "math"), ("gsm8k", "2", "math"), ("gsm8k", "x", "math"), ("mmlu", "5", "qa")}


def test_logs_and_test_sets(spark, tmp_path):
    (tmp_path / "a.log").write_text("step:1 - val-core/gsm8k/acc/mean@1:0.5\n")
    assert readers.read_logs(spark, str(tmp_path / "a.log")).count() == 1
    for name in ("gsm8k", "piqa"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "sets" / f"{name}_sampled_test.parquet"))
    one = tmp_path / "flat"
    one.mkdir()
    for name in ("gsm8k", "piqa", "math"):
        part = next((tmp_path / "sets" / f"{'piqa' if name == 'piqa' else 'gsm8k'}_sampled_test.parquet").glob("*.parquet"))
        (one / f"{name}_sampled_test.parquet").write_bytes(part.read_bytes())
    kept = readers.read_test_sets(spark, str(one), "standard").select("dataset").distinct().collect()
    assert {r["dataset"] for r in kept} == {"gsm8k", "math"}


def test_node_table_is_reused_unless_forced(spark, tmp_path):
    path = str(tmp_path / "nodes")
    node = spark.createDataFrame([("query", 1, None, "math", True, [1.0], None)], NODE)
    assert writers.write_nodes(node, path)
    assert not writers.write_nodes(node, path)
    assert writers.write_nodes(node.unionByName(node), path, force=True)
    assert readers.read_nodes(spark, [path + "_absent", path]).count() == 2


def test_evaluation_files(spark, tmp_path):
    details = spark.createDataFrame([("a", True), ("a", False)], "dataset string, correct boolean")
    summary = spark.createDataFrame([("a", 1, 2, 50.0)], "dataset string, correct bigint, total bigint, accuracy double")
    writers.write_evaluation(details, summary, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "correct")).count() == 1
    assert "1/2 = 50.00%" in spark.read.text(str(tmp_path / "out" / "table")).head()["value"]


def test_fingerprint_round_trip(spark, tmp_path):
    rows = spark.range(100).withColumn("x", F.col("id") * 2)
    manifest = checks.table_fingerprint(rows)
    rows.repartition(7).write.parquet(str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t"))
    assert checks.matches_manifest(again, manifest).head()["matches"]
    assert not checks.matches_manifest(again.where("id > 0"), manifest).head()["matches"]


def test_unbalanced_braces_fail_the_job(spark):
    rows = spark.createDataFrame([("{a}",), ("{b",)], "answer string")
    assert checks.unbalanced(rows, "answer").count() == 1
    with pytest.raises(Exception, match="unbalanced"):
        checks.require_balanced(rows, "answer").collect()


@pytest.fixture(scope="module")
def parts(spark, root, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events") / "parts")
    events = spark.read.parquet(f"{root}/events.parquet")
    for quarter in range(4):  # one file after another, in event-time order
        rows = events.where(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)) == quarter)
        rows.coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_equals_batch_over_several_files(spark, root, parts):
    stream = feeds.shape_events(feeds.stream_of(spark, parts))
    counters = streams.latest_state(streams.route_counters(stream, F.col("query_id") % 5 == 0), "c", ["reward_source"])
    batch = streams.route_counters(feeds.shape_events(spark.read.parquet(parts)), F.col("query_id") % 5 == 0)
    assert sorted(map(tuple, counters.collect())) == sorted(map(tuple, batch.collect()))


def test_append_mode_emits_closed_windows_only(spark, parts):
    stream = feeds.shape_events(feeds.stream_of(spark, parts))
    closed = streams.append_to_table(streams.reward_rate(stream), "w")
    everything = streams.reward_rate(feeds.shape_events(spark.read.parquet(parts)))
    got, full = set(map(tuple, closed.collect())), set(map(tuple, everything.collect()))
    assert got and got < full


def test_redelivered_rows_are_dropped(spark, parts):
    once = feeds.shape_events(feeds.stream_of(spark, parts))
    again = feeds.shape_events(feeds.stream_of(spark, parts))
    kept = streams.append_to_table(streams.drop_redelivered(once.unionByName(again), ["query_id", "resp_idx"], "40 days"), "d")
    assert kept.count() == spark.read.parquet(parts).count()


def test_outcomes_late_missing_and_double(spark, tmp_path):
    """Files arrive one by one; a last far row moves the watermark past every timeout."""
    from rewardloom.streaming.outcomes import outcome_rewards

    def arrive(name, batches, schema):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).selectExpr("id", "to_timestamp((minute + 100000) * 60) AS ts", *["passed"] * ("passed" in schema)).coalesce(
                1).write.mode("append").parquet(str(tmp_path / name))
        return feeds.stream_of(spark, str(tmp_path / name), "part-*.parquet", files_per_batch=1)

    rollouts = arrive("rollouts", [[(1, 0), (2, 0), (3, 1), (4, 2)], [(5, 50)], [(6, 51)], [(99, 10000)]], "id long, minute long")
    tests = arrive("tests", [[(1, 5, True), (1, 6, False), (2, 5, False)], [(4, 30, True)], [(5, 52, True), (6, 40, True)], [(98, 10000, True)]],
                   "id long, minute long, passed boolean")
    out = streams.append_to_table(outcome_rewards(rollouts, tests, ["id"]), "outcomes").collect()
    got = {r.id: (r.reward, r.outcome_ts is not None) for r in out}
    assert len(out) == len(got)
    assert got == {1: (1.0, True), 2: (0.0, True), 3: (0.0, False), 4: (0.0, False), 5: (1.0, True), 6: (0.0, False)}
    batch = outcome_rewards(
        spark.read.parquet(str(tmp_path / "rollouts")), spark.read.parquet(str(tmp_path / "tests")), ["id"]).collect()
    assert {r.id: (r.reward, r.outcome_ts is not None) for r in batch if r.id != 99} == got
