"""The folder that driver and executors have in common, and tables stored there, at which lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share; it goes when the session ends.

    Where a local session names no such folder (tests), a temporary one is set once; on a cluster it has to be named.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sonarium-")
        sc.setCheckpointDir(base)
    if ":/" not in base:
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/sonarium-{uuid.uuid4().hex}-{tag}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and no lost executor takes it along."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
