"""Registered queries: metrics, run selection and training logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rewardloom.operators import metrics, runlog, scoring
from rewardloom.operators.ranking import first_rows, ordered_rank
from rewardloom.plans.queries_text import duck_boxed, duck_hash_answer, duck_letter
from rewardloom.plans.queries_reward import IS_QA, duck_math_correct
from rewardloom.plans.registry import ROLLOUTS, ctes, query, r6
from rewardloom.schema import VALIDATION_SIZES
from rewardloom.sources import feeds

SCORED = ctes("scored")

# Rows of the scored feed once per data set and once overall.
SCOPED = SCORED + """,
scoped AS (SELECT dataset AS scope, * FROM scored UNION ALL SELECT 'overall', * FROM scored),
c AS (SELECT scope, count(*) FILTER (prob > 0.5 AND reward > 0.5) AS tp, count(*) FILTER (prob <= 0.5 AND reward <= 0.5) AS tn,
  count(*) FILTER (prob > 0.5 AND reward <= 0.5) AS fp, count(*) FILTER (prob <= 0.5 AND reward > 0.5) AS fn,
  avg(prob) FILTER (reward > 0.5) AS pos_mean, avg(prob) FILTER (reward <= 0.5) AS neg_mean FROM scoped GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall,
  (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fp_rate,
  CASE WHEN fn + tp > 0 THEN fn / (fn + tp)::DOUBLE ELSE 0 END AS fn_rate, (tp + fn) / (tp + tn + fp + fn)::DOUBLE AS positive_rate FROM c),
full_metrics AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
  accuracy - positive_rate AS improvement, precision - positive_rate AS precision_delta, coalesce(pos_mean - neg_mean, 0) AS score_separation FROM m)
"""
AUC = """,
bins AS (SELECT scope, prob, count(*) FILTER (reward > 0.5) AS p, count(*) FILTER (reward <= 0.5) AS n FROM scoped GROUP BY ALL),
auc AS (SELECT a.scope, sum(a.p * (b.n * CASE WHEN b.prob < a.prob THEN 1.0::DOUBLE WHEN b.prob = a.prob THEN 0.5::DOUBLE ELSE 0 END)) AS wins
  FROM bins a JOIN bins b ON a.scope = b.scope GROUP BY 1),
roc AS (SELECT auc.scope, CASE WHEN (tp + fn) * (fp + tn) > 0 THEN wins / ((tp + fn) * (fp + tn))::DOUBLE ELSE 0.5 END AS roc_auc FROM auc JOIN c ON c.scope = auc.scope)
"""


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def duck_rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)


@query("agg1_confusion", SCOPED + "SELECT scope, tp, tn, fp, fn FROM c")
def _(spark, root):
    return metrics.confusion_counts(feeds.scored(spark, root), "dataset").select("scope", "tp", "tn", "fp", "fn")


@query("agg2_precision_recall", SCOPED + f"SELECT scope, {duck_rounded('precision', 'recall', 'f1')} FROM full_metrics")
def _(spark, root):
    out = metrics.classification(metrics.confusion_counts(feeds.scored(spark, root), "dataset"))
    return rounded(out.select("scope", "precision", "recall", "f1"), "precision", "recall", "f1")


_RATES = ["fp_rate", "fn_rate", "accuracy", "positive_rate", "improvement", "precision_delta"]


@query("agg3_rates", SCOPED + f"SELECT scope, {duck_rounded(*_RATES)} FROM full_metrics")
def _(spark, root):
    counts = metrics.confusion_counts(feeds.scored(spark, root), "dataset")
    return rounded(metrics.classification(counts).select("scope", *_RATES), *_RATES)


@query("agg3_raw_positive_rate", SCORED + """
SELECT dataset AS scope, round(avg(reward / 2), 6) AS positive_rate FROM scored GROUP BY 1
UNION ALL SELECT 'overall', round(avg(reward / 2), 6) FROM scored""")
def _(spark, root):
    halved = feeds.scored(spark, root).withColumn("reward", F.col("reward") / 2)
    out = metrics.classification(metrics.confusion_counts(halved, "dataset"), raw_positive_rate=True)
    return rounded(out.select("scope", "positive_rate"), "positive_rate")


@query("agg4_roc_auc", SCOPED + AUC + "SELECT scope, round(roc_auc, 6) AS roc_auc FROM roc")
def _(spark, root):
    return rounded(metrics.roc_auc(feeds.scored(spark, root), "dataset"), "roc_auc")


@query("agg5_score_separation", SCOPED + f"SELECT scope, {duck_rounded('score_separation')} FROM full_metrics")
def _(spark, root):
    counts = metrics.confusion_counts(feeds.scored(spark, root), "dataset")
    return rounded(metrics.classification(counts).select("scope", "score_separation"), "score_separation")


_ALL = ["precision", "recall", "f1", *_RATES, "score_separation"]


@query("agg6_evaluation", SCOPED + AUC + f"SELECT scope, tp, tn, fp, fn, {duck_rounded(*_ALL, 'roc_auc')} FROM full_metrics JOIN roc USING (scope)")
def _(spark, root):
    out = metrics.evaluate(feeds.scored(spark, root), "dataset")
    return rounded(out.select("scope", "tp", "tn", "fp", "fn", *_ALL, "roc_auc"), *_ALL, "roc_auc")


@query("agg7_label_thresholds", SCORED + """
SELECT dataset, CAST(count(*) FILTER (value > 0.5) AS BIGINT) AS above_half, CAST(count(*) FILTER (value > 0) AS BIGINT) AS above_zero
FROM (SELECT dataset, reward * (resp_idx % 3) / 2 AS value FROM scored) GROUP BY 1""")
def _(spark, root):
    value = F.col("reward") * (F.col("resp_idx") % 3) / 2
    rows = feeds.scored(spark, root).withColumn("value", value)
    return rows.groupBy("dataset").agg(
        F.sum(metrics.label(F.col("value"), 0.5)).alias("above_half"), F.sum(metrics.label(F.col("value"), 0.0)).alias("above_zero"))


@query("agg8_positive_weight", SCORED + """
SELECT count(*) FILTER (reward > 0.5) AS pos, count(*) FILTER (reward <= 0.5) AS neg,
  round(count(*) FILTER (reward <= 0.5) / (count(*) FILTER (reward > 0.5))::DOUBLE, 6) AS pos_weight FROM scored""")
def _(spark, root):
    return rounded(metrics.positive_weight(feeds.scored(spark, root)), "pos_weight")


@query("agg9_weighted_bce", SCORED + """
SELECT dataset, round(avg(1.5::DOUBLE * reward * ln(1 + exp(-(prob * 4 - 2))) + (1 - reward) * ln(1 + exp(prob * 4 - 2))), 6) AS loss FROM scored GROUP BY 1""")
def _(spark, root):
    logit = F.col("prob") * 4 - 2
    return feeds.scored(spark, root).groupBy("dataset").agg(
        r6(metrics.weighted_bce(logit, F.col("reward"), F.lit(1.5))).alias("loss"))


@query("agg10_ranking_loss", SCORED + """
SELECT count(*) AS pairs, round(avg(greatest(0, 0.5::DOUBLE - (a.prob - b.prob))), 6) AS ranking_loss
FROM scored a JOIN scored b ON a.query_id = b.query_id AND a.reward > 0.5 AND b.reward <= 0.5""")
def _(spark, root):
    return rounded(metrics.ranking_loss(feeds.scored(spark, root), "query_id", "prob"), "ranking_loss")


_DETAILS = ROLLOUTS + f""",
pred AS (SELECT *, coalesce({duck_hash_answer('response')}, {duck_boxed('response')}) AS m, {duck_letter('response', 'E', 'D', 'NULL')} AS l FROM rollouts),
details AS (SELECT data_source AS dataset, coalesce(CASE WHEN {IS_QA} THEN l = ground_truth ELSE m IS NOT NULL AND {duck_math_correct('m', 'ground_truth')} END, false) AS correct,
  query_id % 100 AS prompt_tokens, length(response) AS completion_tokens FROM pred),
d AS (SELECT dataset AS scope, * FROM details UNION ALL SELECT 'overall', * FROM details)
"""


def details(spark, root):
    rows = feeds.rollouts(spark, root)
    verdict = scoring.evaluate(F.col("response"), F.col("data_source"), F.col("ground_truth"))
    return rows.select(
        F.col("data_source").alias("dataset"), verdict.alias("correct"), (F.col("query_id") % 100).alias("prompt_tokens"),
        F.length("response").alias("completion_tokens"),
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


@query("agg11_accuracy_report", _DETAILS + """
SELECT scope, count(*) FILTER (correct) AS correct, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (correct) / count(*), 2) AS accuracy,
  round(sum(prompt_tokens) / count(*)::DOUBLE, 2) AS avg_prompt_tokens, round(sum(completion_tokens) / count(*)::DOUBLE, 2) AS avg_completion_tokens,
  round(sum(prompt_tokens + completion_tokens) / count(*)::DOUBLE, 2) AS avg_total_tokens FROM d GROUP BY 1""")
def _(spark, root):
    return metrics.accuracy_report(details(spark, root))


@query("agg12_accuracy_summary", _DETAILS + """
SELECT scope, count(*) FILTER (correct) AS correct, count(*) AS total, round(count(*) FILTER (correct) / count(*)::DOUBLE * 100, 6) AS accuracy FROM d GROUP BY 1""")
def _(spark, root):
    return rounded(metrics.accuracy_summary(details(spark, root)), "accuracy")


_NAMES = ["gsm8k", "humaneval_plus", "gpqa", "mbpp_plus", "unlisted"]
_NAME_SQL = "['gsm8k', 'humaneval_plus', 'gpqa', 'mbpp_plus', 'unlisted'][CAST(event_id % 5 AS INTEGER) + 1]"


def step_scores(spark, root):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 5 + 1).cast("int"))
    return feeds.table(spark, root, "events").groupBy(
        (F.col("user_id") % 30).alias("step"), name.alias("dataset")
    ).agg(F.round(F.avg(F.floor("value") / 500.0), 6).alias("score"))


def weights(spark):
    return spark.createDataFrame(list(VALIDATION_SIZES.items()), "dataset string, weight int")


_WEIGHTED = f"""
WITH s AS (SELECT user_id % 30 AS step, {_NAME_SQL} AS dataset, round(avg(floor(value) / 500.0::DOUBLE), 6) AS score FROM events GROUP BY ALL),
w AS (SELECT * FROM (VALUES ('gsm8k', 300), ('humaneval_plus', 26), ('gpqa', 39), ('mbpp_plus', 52)) t(dataset, weight)),
a AS (SELECT step, sum(score * weight) / sum(weight) AS weighted_avg FROM s JOIN w USING (dataset) GROUP BY 1)
"""


@query("agg13_weighted_average", _WEIGHTED + "SELECT step, round(weighted_avg, 6) AS weighted_avg FROM a")
def _(spark, root):
    out = metrics.weighted_average(step_scores(spark, root), weights(spark), ["step"])
    return rounded(out, "weighted_avg")


_RUNS = """
WITH runs AS (SELECT CAST(user_id % 40 AS INTEGER) AS run, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 2) AS fp_rate,
  round(avg(floor(value) / 500.0::DOUBLE), 6) AS f1 FROM events GROUP BY 1)
"""


def runs(spark, root):
    return feeds.table(spark, root, "events").groupBy((F.col("user_id") % 40).cast("int").alias("run")).agg(
        F.round(F.avg(F.when(F.col("value") > 100, 1.0).otherwise(0.0)), 2).alias("fp_rate"),
        F.round(F.avg(F.floor("value") / 500.0), 6).alias("f1"))


@query("agg14_run_statistics", _RUNS + """
SELECT round(avg(fp_rate), 6) AS mean, round(stddev_samp(fp_rate), 6) AS std, min(fp_rate) AS min, max(fp_rate) AS max FROM runs""")
def _(spark, root):
    return rounded(metrics.run_statistics(runs(spark, root)), "mean", "std")


@query("win5_ranked_runs", _RUNS + """
SELECT run, fp_rate, f1, CAST(row_number() OVER (ORDER BY fp_rate, run) AS INTEGER) AS place,
  CASE WHEN row_number() OVER (ORDER BY fp_rate, run) = 1 THEN 'BEST' ELSE '' END AS marker FROM runs""")
def _(spark, root):
    return metrics.rank_runs(runs(spark, root))


@query("win5_ranked_runs_by_f1", _RUNS + """
SELECT run, fp_rate, f1, CAST(row_number() OVER (ORDER BY f1 DESC, run) AS INTEGER) AS place,
  CASE WHEN row_number() OVER (ORDER BY f1 DESC, run) = 1 THEN 'BEST' ELSE '' END AS marker FROM runs""")
def _(spark, root):
    return metrics.rank_runs(runs(spark, root), "f1", descending=True)


_METHODS = """
WITH scores AS (SELECT ['baseline', 'graph', 'oracle'][CAST(event_id % 3 AS INTEGER) + 1] AS method, event_type AS dataset,
  round(avg(floor(value) / 5.0::DOUBLE), 4) AS score FROM events GROUP BY ALL)
"""


def method_scores(spark, root):
    method = F.element_at(F.array(F.lit("baseline"), F.lit("graph"), F.lit("oracle")), (F.col("event_id") % 3 + 1).cast("int"))
    return feeds.table(spark, root, "events").groupBy(method.alias("method"), F.col("event_type").alias("dataset")).agg(
        F.round(F.avg(F.floor("value") / 5.0), 4).alias("score"))


@query("agg18_method_comparison", _METHODS + """
SELECT s.method, s.dataset, s.score, round(s.score - b.score, 6) + 0.0::DOUBLE AS delta, round(s.score / o.score * 100, 6) AS percent_of_oracle
FROM scores s JOIN scores b ON b.method = 'baseline' AND b.dataset = s.dataset JOIN scores o ON o.method = 'oracle' AND o.dataset = s.dataset""")
def _(spark, root):
    return rounded(metrics.compare_methods(method_scores(spark, root), "baseline", "oracle"), "delta", "percent_of_oracle")


@query("agg18_method_table", _METHODS + """
SELECT dataset, max(score) FILTER (method = 'baseline') AS baseline, max(score) FILTER (method = 'graph') AS graph,
  max(score) FILTER (method = 'oracle') AS oracle FROM scores GROUP BY 1""")
def _(spark, root):
    return metrics.method_table(method_scores(spark, root), ["baseline", "graph", "oracle"])


# --- top-k and running windows ----------------------------------------------

@query("win1_top_k", """
SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 7""")
def _(spark, root):
    rows = feeds.table(spark, root, "events").select("user_id", "event_id", "value")
    return first_rows(rows, ["user_id"], [F.col("value").desc(), F.col("event_id")], 7)


@query("win2_first_occurrence", """
WITH s AS (SELECT event_type, user_id, min(event_id) AS first_pos FROM events GROUP BY ALL)
SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY first_pos) AS rank FROM s""")
def _(spark, root):
    seen = feeds.table(spark, root, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first_pos"))
    return ordered_rank(seen, ["event_type"], "first_pos").select("event_type", "user_id", "rank")


_AVG = _WEIGHTED + ", avgs AS (SELECT step, round(weighted_avg, 4) AS avg_score FROM a)"


def step_averages(spark, root):
    out = metrics.weighted_average(step_scores(spark, root), weights(spark), ["step"])
    return out.select("step", F.round("weighted_avg", 4).alias("avg_score"))


@query("win3_best_steps", _AVG + """
SELECT step, avg_score, coalesce(avg_score > max(avg_score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improves,
  step = (SELECT step FROM avgs ORDER BY avg_score DESC, step LIMIT 1) AS is_best FROM avgs""")
def _(spark, root):
    return runlog.best_steps(step_averages(spark, root))


@query("win3_best_step", _AVG + "SELECT step AS best_step, avg_score AS best_score FROM avgs ORDER BY avg_score DESC, step LIMIT 1")
def _(spark, root):
    return runlog.best_step(step_averages(spark, root))


@query("str12_parsed_log", ctes("log_lines") + """
, l AS (SELECT event_id, CAST(regexp_extract(line, 'step:(\\d+)\\s', 1) AS BIGINT) AS step, line FROM log_lines),
last AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY step ORDER BY event_id DESC) = 1)
SELECT step, unnest(regexp_extract_all(line, 'val-core/(\\w+)/(?:acc|reward)/mean@1:([\\d.]+)', 1)) AS dataset,
  CAST(unnest(regexp_extract_all(line, 'val-core/(\\w+)/(?:acc|reward)/mean@1:([\\d.]+)', 2)) AS DOUBLE) AS score FROM last""")
def _(spark, root):
    return runlog.parse_log(feeds.log_lines(spark, root), "event_id")


@query("win4_early_stopping", ctes("epoch_history") + """,
r AS (SELECT *, metric > greatest(0, coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS improved,
  row_number() OVER (PARTITION BY run ORDER BY epoch) AS place FROM epoch_history),
g AS (SELECT *, place - coalesce(max(CASE WHEN improved THEN place END) OVER (PARTITION BY run ORDER BY epoch), 0) AS idle FROM r),
s AS (SELECT run, coalesce(min(place) FILTER (idle >= 4), max(place)) AS stop_place FROM g GROUP BY 1)
SELECT g.run, coalesce(max(epoch) FILTER (improved), 0) AS best_epoch, coalesce(max(metric) FILTER (improved), 0) AS best_metric, max(epoch) AS total_epochs
FROM g JOIN s ON s.run = g.run AND place <= stop_place GROUP BY 1""")
def _(spark, root):
    return runlog.early_stopping(feeds.epoch_history(spark, root), "run", 4)


@query("win7_best_rollout", SCORED + """
SELECT query_id, arg_max(resp_idx, prob) AS best_resp, max(prob) AS best_prob, arg_max(reward, prob) AS best_reward, any_correct, n FROM (
  SELECT query_id, resp_idx, prob, reward, bool_or(reward > 0.5) OVER (PARTITION BY query_id) AS any_correct, count(*) OVER (PARTITION BY query_id) AS n,
    row_number() OVER (PARTITION BY query_id ORDER BY prob DESC, resp_idx) AS place FROM scored) WHERE place = 1 GROUP BY query_id, any_correct, n""")
def _(spark, root):
    return metrics.best_rollout(feeds.scored(spark, root), "query_id")
