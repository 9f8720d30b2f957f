"""A hit store on shared storage: one Parquet folder, partitioned by chromosome and sorted by position inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class HitStore:
    """Every write makes a new version beside the one in use, so readers and lost executors never see half of one."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema, self.version = spark, path, schema, 0

    def _write(self, rows: DataFrame, mode: str, version: int) -> None:
        rows.repartition("chrom").sortWithinPartitions("chrom", "pos", "hit").write.mode(mode).partitionBy("chrom").parquet(f"{self.path}/v{version}")

    def read(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}")

    def store(self, rows: DataFrame) -> None:
        """Replaces all hits."""
        self._write(rows, "error", self.version + 1)
        self.version += 1

    def append(self, rows: DataFrame) -> None:
        """Adds hits: as new files where every chromosome's new hits lie behind the old, else by a merge."""
        if not self.version:
            return self.store(rows)
        last = self.read().groupBy("chrom").agg(F.max("pos").alias("last"))
        first = rows.groupBy("chrom").agg(F.min("pos").alias("first"))
        if first.join(last, "chrom").where("first <= last").limit(1).count():
            return self.merge(rows)
        self._write(rows, "append", self.version)

    def merge(self, rows: DataFrame) -> None:
        """Adds hits anywhere; each chromosome is sorted again."""
        self.store(self.read().unionByName(rows))

    def delete(self, chroms: list[int]) -> None:
        self.store(self.read().where(~F.col("chrom").isin(chroms)))

    def exists(self, chroms: list[int]) -> DataFrame:
        """chrom, whether the store has hits there."""
        asked = self.spark.createDataFrame([(c,) for c in chroms], "chrom int")
        return asked.join(self.read().select("chrom").distinct().withColumn("found", F.lit(True)), "chrom", "left").select("chrom", F.coalesce("found", F.lit(False)).alias("found"))
