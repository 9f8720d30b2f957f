"""Structured Streaming twins of the batch operators, run over what is there now.

A stream's updates are written batch by batch to the shared folder; the last update of a key is its result, so nothing is
kept in the driver and a restarted batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import new_path


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's Parquet files of one name as a stream, with the schema they have."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")
    zoneless = [c for c, t in stream.dtypes if t == "timestamp_ntz"]  # event time has to be an instant
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def latest(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs the stream to its present end and returns each key's last row."""
    spark = stream.sparkSession
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
    root = new_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(root)
    if not rest:
        return got.select(*keys).distinct()
    got = got.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
    return got.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day", by: tuple[Column, ...] = ()) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("w_start"), *[c for c in out.columns if c not in ("w", "n", "total")], "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("w_start"), F.col("w.end").cast("timestamp_ntz").alias("w_end"), "n")
