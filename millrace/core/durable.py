"""Cuts lineage in a place that outlives any executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may do without the setting."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, rows: int | None = None, lot: int = 50_000) -> DataFrame:
    """The same rows read back from a reliable checkpoint.

    rows, an upper bound of their number where one is known, keeps a small table from
    being written as many tiny files: it gets a file for each lot rows at most.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // lot)))
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder through Hadoop's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(*done: DataFrame) -> None:
    """Delete the files of tables that cut() gave, once nothing reads them any more."""
    for df in done:
        plan = df._jdf.queryExecution().logical()
        rdd = plan.rdd() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if rdd is not None and rdd.getCheckpointFile().isDefined():
            delete(df.sparkSession, rdd.getCheckpointFile().get())
