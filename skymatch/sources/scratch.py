"""Folders for what a run stores on its way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that release() deletes.
FOLDERS: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new one below spark.checkpoint.dir, which all executors see. Where that is unset, as in tests, a local one serves a local master; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    FOLDERS.append(f"{base.rstrip('/')}/skymatch-{uuid.uuid4().hex}")
    return FOLDERS[-1]


def stored(df: DataFrame) -> DataFrame:
    """df written to a folder of its own and read again: what reads it repeats nothing, nor do lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the folders made so far but the first `keep`; results that still read them must be written before. Returns how many there were."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while len(FOLDERS) > keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(FOLDERS.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n
