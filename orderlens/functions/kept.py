"""Tables written to the folder that driver and executors share, where a plan would otherwise be computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that this program wrote.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder on one machine, while a cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="orderlens-")


def keep(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: lost executors cost no recomputation, and what reads it twice computes it once."""
    path = f"{shared_folder(df.sparkSession)}/series-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what keep() wrote, once no result needs it; how many tables that were."""
    gone = list(WRITTEN)
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        WRITTEN.remove(name)
    return len(gone)
