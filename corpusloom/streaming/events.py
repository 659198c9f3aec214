"""Windows, sessions and duplicate removal over event streams; an addition of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind. Works on a batch and on a stream, where rows later than the watermark are dropped."""
    counted = timed(events, time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    found = timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return found.select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    return timed(events, time, late).dropDuplicatesWithinWatermark([key])
