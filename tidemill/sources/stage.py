"""Stage tables: results written to the shared folder and read again, so that each is made once, and deleted after use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and the master is local, a temporary one."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", held)
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


class Stages:
    """The tables of one run, in a folder of their own.

    ``put`` writes a table and returns it read back: its plan is one scan, whatever made
    it, and the loss of an executor recomputes nothing that lies before. ``drop`` deletes
    tables that nothing will read again, ``close`` the whole folder.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.held = spark, f"{shared_dir(spark)}/tidemill-{name}-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        self.held[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        return self.held[name]

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            if self.held.pop(name, None) is not None:
                self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        self.held.clear()
        self._delete(self.path)
