"""Session helpers: tables, checkpoint folder and written intermediate results."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def get_spark(app: str = "orrery", **conf: str) -> SparkSession:
    """A session with the engine's defaults; values given by the cluster's own configuration win."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a session without one (a test) gets a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="orrery-checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there: lineage ends, lost executors cost nothing.

    The files go when the returned DataFrame is no longer referenced, if the cluster cleans checkpoints.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write df as a table in the checkpoint folder and read it from there.

    For rows with texts: the table is compressed, and those who read a few columns read only these.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let go of the files of shuffles and checkpoints that nothing refers to any more.

    The cluster deletes them when the driver collects its garbage, which a driver with room in its heap may put off while
    many rounds fill the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
