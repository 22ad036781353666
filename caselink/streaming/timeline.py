"""Optional streaming forms: a deduplicated timeline and incremental links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def unique(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each event once; state is dropped behind the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def activity(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events by window and type."""
    per = events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def upsert_edges(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Edges of a batch (src, rel_type, dst, weight) merged into the known ones; for use in foreachBatch with a table swap."""
    every = batch if known is None else known.unionByName(batch)
    return every.groupBy("src", "rel_type", "dst").agg(F.max("weight").alias("weight"))
