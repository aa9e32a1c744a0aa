"""Job folders, and sessions whose workers do not have the package."""

import os
import subprocess
import sys
import time

from pyspark.sql import functions as F

from rewardloom import session
from rewardloom.operators import sampling
from rewardloom.session import cut_lineage, scratch_folder

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_a_job_leaves_no_tables(spark):
    with scratch_folder(spark) as folder:
        assert cut_lineage(spark.range(3)).count() == 3
        local = folder.removeprefix("file:")
        assert os.listdir(local)
    assert not os.path.exists(local)
    assert cut_lineage(spark.range(2)).count() == 2


def test_shuffles_of_a_cut_table_are_removed(spark):
    """They once stayed until the driver collected its garbage, so that those of all steps filled the disks together."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}

    rows = spark.range(5000).groupBy((F.col("id") % 997).alias("k")).agg(F.max("id").alias("v"))
    rows.collect()
    before = held()
    table = cut_lineage(rows.join(spark.range(990).withColumnRenamed("id", "k").hint("merge"), "k"))
    deadline = time.time() + 20
    while held() - before and time.time() < deadline:
        time.sleep(0.2)
    assert before and not held() - before and table.count() == 990
    assert spark.conf.get(session.CLEANUP) == "false"


def test_workers_need_no_package(tmp_path):
    code = f"""
import sys
import time
sys.path.insert(0, {REPO!r})
from rewardloom.session import build_session
from rewardloom.operators.knn import knn_edges
from rewardloom.config import EngineConfig
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id bigint, embedding array<double>")
for config in (EngineConfig(), EngineConfig(broadcast_bytes=1)):
    assert knn_edges(nodes, nodes, 2, exclude="self", config=config).count() == 18
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_samples_of_one_dominant_group(spark):
    rows = spark.range(20000).withColumn("g", F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(9))
    picked = sampling.sample_per_group(rows, ["g"], ["id"], 100)
    sizes = {r["g"]: r["count"] for r in picked.groupBy("g").count().collect()}
    assert sizes[9] == 100 and sum(sizes.values()) == 500  # the small groups have 400 rows together
    assert sorted(picked.columns) == ["g", "id"]
    first = sampling.first_k(rows, ["g"], "id", 3).where("g = 9").select("id").collect()
    assert sorted(r["id"] for r in first) == [1, 2, 3]
