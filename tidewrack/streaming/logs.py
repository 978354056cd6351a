"""Log analytics on streams and, with the same functions, on tables: hourly counts, sessions, click dedup, page ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def _timed(events: DataFrame) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", LATE) if events.isStreaming else rows


def hourly_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, event_type, n."""
    grouped = _timed(events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end (last event plus the gap), n."""
    grouped = _timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def unique_clicks(events: DataFrame) -> DataFrame:
    """Clicks, each event_id once within the watermark."""
    clicks = _timed(events).where("event_type = 'click'")
    return clicks.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else clicks.dropDuplicates(["event_id"])


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str):
    """New pages of a landing folder appended to a table once each, then the stream ends (availableNow)."""

    def add(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(["url"])
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            rows = rows.join(spark.read.parquet(target).select("url"), "url", "left_anti").select(*batch.columns)
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
