"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; it may be deleted when the application ends.

    Without that setting a session on one machine gets a temporary folder, and a cluster is refused: each of its machines
    would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rangeloom-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/rangeloom-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str = "step") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and read back: cuts the lineage of iterative plans and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of a loop: each round's is written before the one before it is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, ""

    def write(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, new_path(self.spark, self.name)
        df.write.parquet(self.path)
        if before:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(before)
            where.getFileSystem(conf).delete(where, True)
        return self.spark.read.schema(df.schema).parquet(self.path)
