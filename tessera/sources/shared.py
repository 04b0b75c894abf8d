"""The folder that driver and executors share, and tables that a job keeps there between its rounds."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or the session's checkpoint folder; where neither is set there is none to write to, and this says so."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return found


class Rounds:
    """Tables of a job that goes on in rounds: each ends lineage, so that a lost executor costs one round, and goes when a later one takes its place."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.paths = spark, os.path.join(shared_dir(spark), f"tessera-{name}-{uuid.uuid4().hex}"), {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as a table, read back. A table that was kept under this name is dropped."""
        path = f"{self.at}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        if path := self.paths.pop(name, None):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
