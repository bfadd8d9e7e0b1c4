"""Cutting lineage in a way that survives the loss of executors.

Intermediate results become parquet tables in the shared checkpoint folder. Unlike a
checkpointed RDD they are columnar and carry exact sizes, so the next plan knows which
side of a join is small enough to broadcast and reads only the columns it needs. They
are removed when the session's file system closes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without one, local mode, where one machine is all there is, gets a folder of its own; a cluster gets an error.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def by_key(df: DataFrame) -> DataFrame:
    """One side of a join that grows with the code: both sides are dealt by the key, none is broadcast.

    Spark knows sizes of files only, and neither the rows that `explode` makes of them nor what compression saved, so it would
    send tables through the driver that don't fit there.
    """
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read on from the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
