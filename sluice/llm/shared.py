"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset, a folder in the warehouse."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors don't lose it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def source_bytes(df: DataFrame) -> int:
    """The optimiser's size of df's sources: of file sources the bytes of their files, 0 where it knows none. No job runs."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def tasks_for(df: DataFrame, each: int = 16 << 20) -> int:
    """Partitions of an exchange of what is made of df: the session's number, or one for ``each`` bytes of its files if these are more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes(df) // each))
