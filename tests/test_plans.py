"""Shapes of physical plans."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from rewardloom.operators import ranking
from rewardloom.plans.catalog import ORACLES, QUERIES
from rewardloom.sources import feeds


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", [
    "grf5_domain_knn", "grf8_same_domain_knn", "grf9_think_knn_in_query", "agg4_roc_auc", "agg10_ranking_loss",
    "join7_pairs_per_query", "smp3_split_by_share", "rwd9_mixed_reward", "join8_presence", "prp1_propagated_reward",
])
def test_no_cross_product(spark, root, name):
    plan = plan_of(QUERIES[name](spark, root))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_prunes_before_the_shuffle(spark, root):
    plan = plan_of(QUERIES["win1_top_k"](spark, root))
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, root):
    df = feeds.table(spark, root, "events").where(F.col("value") > 100).select("event_id", "value")
    plan = plan_of(df)
    assert "GreaterThan(value,100.0)" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_scoring_needs_one_join_and_no_python(spark, root):
    plan = plan_of(QUERIES["rwd1_math_reward"](spark, root))
    assert "Python" not in plan and "Window" not in plan


def test_rank_windows_carry_a_bucket(spark, root):
    ranked = ranking.shuffled_rank(feeds.queries(spark, root), ["data_source"], ["query_id"])
    plan = plan_of(ranked)
    assert "_bucket" in plan


def test_every_name_is_registered_once_and_has_a_family():
    assert len(QUERIES) >= 150
    assert set(ORACLES) <= set(QUERIES)


def test_fit_reads_a_stored_search(spark, root, monkeypatch):
    """The fit passes over its rows many times; the neighbours are searched before, once."""
    from rewardloom.operators import propagate

    plans, fit = [], propagate.fit_rewards
    monkeypatch.setattr(propagate, "fit_rewards", lambda rows, columns: plans.append(
        rows._jdf.queryExecution().optimizedPlan().toString()) or fit(rows, columns))
    assert QUERIES["prp6_fitted_rewards"](spark, root).count() > 0
    assert plans and not any(word in plans[0] for word in ("MapIn", "Aggregate", "Join"))


def test_nodes_search_memory_once(spark, root):
    from rewardloom.operators import graph
    from rewardloom.plans.queries_graph import nodes_of

    nodes = nodes_of(spark, root)
    edges = lambda df: sorted((r["src"], r["dst"], round(r["sim"], 9)) for r in df.collect())
    both = graph.similar_in_memory(nodes).unionByName(graph.similar_to_memory(nodes))
    assert edges(graph.remembered(nodes)) == edges(both)
    plan = QUERIES["prp7_transductive"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_statistics_of_structural_edges_write_no_edges(spark, root):
    from rewardloom.operators import graph

    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (3, 3)], "query_id bigint, resp_idx bigint")
    listed = graph.edge_statistics(graph.structural_edges(rows))
    assert sorted(map(tuple, graph.structural_statistics(rows).collect())) == sorted(map(tuple, listed.collect()))
    assert graph.structural_statistics(rows.limit(0)).count() == 0
    plan = QUERIES["grf15_edge_statistics"](spark, root)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [edge_type" not in plan and "concat_ws" not in plan.split("Aggregate")[1]
