"""Session construction and the shared scratch folder.

Two facts drive everything here: results are compared under a fixed UTC clock,
and executors share no local disk, so every table an iterative operator writes
on its way goes below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints/meshline"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with AQE, sized for `master`; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if is_local(master):
        settings |= {"spark.checkpoint.dir": LOCAL_CHECKPOINTS, "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1"}
    settings |= conf
    return SparkSession.builder.master(master).appName("meshline").config(map=settings).getOrCreate()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``. Where it is unset a local one is set if the master
    is local; on a cluster that is an error, as executors share no local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
        found = LOCAL_CHECKPOINTS
    return found


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/meshline-{what}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Materialise `df` in the shared folder and read it again: lineage ends
    there, and a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path_of_cut"] = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove the table behind a DataFrame that cut() gave, once nothing reads
    it any more; others are left alone. Loops call it as a round replaces the
    one before, so the shared folder holds a few rounds at a time."""
    path = None if df is None else df.__dict__.get("scratch_path_of_cut")
    if path:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this library; call it when no pending
    result still reads one."""
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        for found in fs.listStatus(path):
            if found.getPath().getName().startswith("meshline-"):
                fs.delete(found.getPath(), True)
