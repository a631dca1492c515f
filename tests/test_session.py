"""Where intermediates go."""

import os
import time
import types

import pytest
from pyspark.sql import functions as F

from groundcheck.session import CHECKPOINT_CONF, CLEANUP_CONF, materialize, release, shared_folder


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    none = types.SimpleNamespace(isDefined=lambda: False)
    context = types.SimpleNamespace(
        master=master, getConf=lambda: {}, _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none))
    )
    fake = types.SimpleNamespace(conf={}, sparkContext=context)
    with pytest.raises(ValueError, match=CHECKPOINT_CONF):
        shared_folder(fake)


def test_configured_folder_is_used(spark):
    assert shared_folder(spark) == spark.conf.get(CHECKPOINT_CONF)


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(disk.getAllFiles().mkString("|").split("|"))
    before, setting = files(), spark.conf.get(CLEANUP_CONF, None)
    stored = materialize(spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count())
    for _ in range(50):
        if not {f for f in files() - before if "shuffle" in f}:
            break
        time.sleep(0.2)
    assert not {f for f in files() - before if "shuffle" in f}
    assert spark.conf.get(CLEANUP_CONF, None) == setting and stored.count() == 7000


def test_a_released_table_is_deleted(spark):
    kept, gone = materialize(spark.range(3)), materialize(spark.range(4))
    release(gone)
    assert not os.path.exists(gone._stage) and os.path.exists(kept._stage) and kept.count() == 3
