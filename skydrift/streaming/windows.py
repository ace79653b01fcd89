"""Streams of events: hopping windows and sessions with a watermark, in batch the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(df: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark, for which times must have a zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else df


def hopping(df: DataFrame, time: str, key: str, value: str, length: str, hop: str, late: str | None = None) -> DataFrame:
    """(start, key, n, total) per window, hop and key. On a stream rows later than ``late`` are dropped."""
    df = _watermarked(df, time, late)
    g = df.groupBy(F.window(time, length, hop).alias("w"), key)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, n) of rows of a key that follow each other within ``gap``; the end is that of the gap after the last."""
    df = _watermarked(df, time, late)
    return df.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_versions(df: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows of a stream whose key and time weren't seen before within ``late``: repeated deliveries are dropped."""
    return _watermarked(df, time, late).dropDuplicatesWithinWatermark([key, time])
