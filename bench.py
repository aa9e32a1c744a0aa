"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from rewardloom.plans.catalog import QUERIES
from rewardloom.session import build_session

HEADLINE = [
    "rwd1_math_accuracy", "rwd5_batch_scoring", "fea5_self_consistency", "rte2_group_routes", "smp3_split_by_share",
    "grf5_domain_knn", "grf5_domain_knn_blocks", "grf7_new_to_memory_knn", "prp1_propagated_reward", "prp2_message_layer", "agg4_roc_auc",
    "agg6_evaluation", "agg10_ranking_loss", "agg11_accuracy_report", "smp1_dedupe", "rwd9_mixed_summary",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flt1_domain_nodes"](spark, root).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
