"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A query's shuffle files go as soon as it has ended.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = {"lock": threading.Lock(), "running": 0, "before": None}


def build_session(app: str = "groundcheck", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    AQE does the work that depends on the data: it coalesces small shuffle partitions, splits
    skewed join partitions, and turns a join into a broadcast join once it has seen that a side
    is small. The library itself forces a broadcast only where a parameter bounds the side.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the configured checkpoint folder.

    Only a local master may go without: driver and executors then are one process, and a temporary folder is made and set. On a
    cluster a machine-local folder would hold a part of the rows per machine, so a missing setting is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="groundcheck-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files. Several threads may be inside; the last one out restores the setting."""
    state = _cleaning
    with state["lock"]:
        if not state["running"]:
            state["before"] = spark.conf.get(CLEANUP_CONF, None)
            spark.conf.set(CLEANUP_CONF, "true")
        state["running"] += 1
    try:
        yield
    finally:
        with state["lock"]:
            state["running"] -= 1
            if not state["running"]:
                spark.conf.unset(CLEANUP_CONF) if state["before"] is None else spark.conf.set(CLEANUP_CONF, state["before"])


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one intermediate feeds several jobs. The written table cuts the lineage and
    survives the loss of any executor, which a cached copy does not. The shuffle files of the write go with it.
    """
    path = scratch_path(df.sparkSession, "stage")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def release(*stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables. Nothing that is still to run may read them."""
    for df in stored:
        spark, path = df.sparkSession, df._stage
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a table that is read in fewer splits than there are cores, by its unique key.

    The text work is CPU-bound, and one small file is one task. A table with more splits
    than cores is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
