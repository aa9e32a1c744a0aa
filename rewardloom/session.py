"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings a running session may take on; none of them changes a result. A hot
# join key is split at run time even where an aggregate on the same key follows.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
DEFAULTS = {
    **RUNTIME,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "rewardloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above. Keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Applies the run-time settings to a session that somebody else built."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    A folder of our own is used only where the session runs inside one JVM and
    names none, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="rewardloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A folder inside the shared one for the tables cut within; deleted when the work inside is done."""
    folder = f"{shared_folder(spark)}/job-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_folder(spark: SparkSession) -> str:
    """Where cut tables go just now: the scratch folder in use, else the shared one."""
    return _SCRATCH.get() or shared_folder(spark)


#: Spark's setting that removes the shuffles of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back.

    The shuffles made for it go once it is there; else they stay on the executors'
    disks until the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, name: str = "cut", folder: str | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it back.

    Lost executors then recompute nothing above it, several readers share it,
    and each of them reads only the columns it needs. Inside :func:`scratch_folder`
    the table goes into that job's folder, and with it, unless ``folder`` names another.
    """
    return store(df, f"{folder or work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
