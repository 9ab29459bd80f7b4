"""Where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in spark.checkpoint.dir; a folder of this machine only on a local master without one."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(shared)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame that checkpoint() gave, once nothing reads it any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and (file := plan.rdd().getCheckpointFile()).isDefined():
        _delete(df.sparkSession, file.get())


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete what this session has checkpointed: frames that still read it can't be used afterwards."""
    place = spark.sparkContext.getCheckpointDir()
    if place is not None:
        _delete(spark, place)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
