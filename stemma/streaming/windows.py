"""Windowed counts with watermarks, and an append-only cache of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_window(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total by window of event time; a stream drops what is later than `late` and then forgets the window."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of runs of events with no gap as long as `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_answers(keys: DataFrame, answers_path: str, checkpoint: str, fetch):
    """Starts a stream that asks for keys not answered yet and appends the answers (Parquet); fetch as in sources.tables.fetched."""
    from ..sources.tables import ANSWER, fetched, unanswered

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(f"cache_key string, answer {ANSWER}").parquet(answers_path)
        fetched(unanswered(batch, known), fetch).write.mode("append").parquet(answers_path)

    return keys.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
