"""External reward functions: Python scorers over parallel lists, fed with whole prompt groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``score(data_sources, solution_strs, ground_truths, extra_infos)`` gives a number for each row.
Scorer = Callable[[list, list, list, list], list]


def _rewards(scorer: Scorer, rows: list[dict]) -> tuple[list, list]:
    """Rewards and errors of one call; whatever the scorer does, every row gets one or the other."""
    try:
        found = list(scorer(*[[r[name] for r in rows] for name in ("data_source", "response", "ground_truth", "extra_info")]))
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} scores for {len(rows)} rows")
        return [None if x is None else float(x) for x in found], [None] * len(rows)
    except Exception as problem:  # a scorer is foreign code
        return [None] * len(rows), [f"{type(problem).__name__}: {problem}"] * len(rows)


def external_reward(rollouts: DataFrame, scorer: Scorer, group: list[Column], call_rows: int = 1024,
                    most_rows: int = 65536) -> DataFrame:
    """``group_key, resp_idx, reward, error``: rollouts scored by a Python function over parallel lists.

    ``rollouts`` have data_source, response, ground_truth, extra_info and resp_idx;
    ``group`` names the prompt group. A call sees whole groups, in order of
    ``resp_idx``, and as many of them as fit into ``call_rows`` rows. A group of more
    than ``most_rows`` rows would not fit into a task and is not scored: its rows
    carry the error ``group too large``. An exception, a wrong number of scores or
    one that is no number gives every row of that call a null reward and the error,
    so that other calls go on. Null group keys form one group, nulls reach the scorer as None.
    """
    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(group)])
    rows = rollouts.select(key.alias("group_key"), "resp_idx", "data_source", "response", "ground_truth", "extra_info")
    sizes = rows.groupBy("group_key").agg((F.count("*") > most_rows).alias("large"))
    large = sizes.where("large").select("group_key")
    fit = rows.join(large, rows["group_key"].eqNullSafe(large["group_key"]), "left_anti")
    refused = rows.join(large, rows["group_key"].eqNullSafe(large["group_key"]), "left_semi")
    placed = fit.repartition("group_key").sortWithinPartitions("group_key", "resp_idx")
    schema = T.StructType([rows.schema["group_key"], rows.schema["resp_idx"],
                           T.StructField("reward", T.DoubleType()), T.StructField("error", T.StringType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = None
        ready: list[dict] = []   # whole groups for the next call
        current: list[dict] = []  # the group that still comes in

        def call() -> Iterator[pa.RecordBatch]:
            if ready:
                rewards, errors = _rewards(scorer, ready)
                yield pa.RecordBatch.from_pylist([
                    {"group_key": r["group_key"], "resp_idx": r["resp_idx"], "reward": x, "error": e}
                    for r, x, e in zip(ready, rewards, errors, strict=True)], arrow)
                ready.clear()

        for batch in batches:
            arrow = arrow or pa.schema([batch.schema.field("group_key"), batch.schema.field("resp_idx"),
                                        ("reward", pa.float64()), ("error", pa.string())])
            for row in batch.to_pylist():
                if current and row["group_key"] != current[0]["group_key"]:
                    if len(ready) + len(current) > call_rows:
                        yield from call()
                    ready += current
                    current = []
                current.append(row)
        if len(ready) + len(current) > call_rows:
            yield from call()
        ready += current
        yield from call()

    done = placed.mapInArrow(scored, schema)
    return done.unionByName(refused.select(
        "group_key", "resp_idx", F.lit(None).cast("double").alias("reward"), F.lit("group too large").alias("error")))
