"""Events of growing logs as Structured Streaming.

A layout's parser is made of plain expressions, so it works on a stream of lines
as it is. Ten-minute bins are windowed counts with a watermark; sessions are
session windows by context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.operators.formats import GENERIC, LAYOUTS


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear: ``source_id`` is the file's name."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_id"), F.lit(None).cast("long").alias("line_no"), F.col("value").alias("text"), F.lit(None).cast("date").alias("file_date"))


def stamped_events(lines: DataFrame, layout: str) -> DataFrame:
    """Events of the lines that a layout recognizes; a stream has no line before another, so others wait for the batch import."""
    chosen = LAYOUTS.get(layout, GENERIC)
    return chosen.parse(lines.where(chosen.recognizes(F.col("text")))).withColumn("ts", F.col("wall").cast("timestamp"))


def live_bins(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Counts by source, ten minutes and severity; events later than ``late`` are dropped by the watermark."""
    counted = events.withWatermark("ts", late).groupBy("source_id", F.window("ts", "10 minutes").alias("w"), "severity").agg(F.count("*").alias("n"))
    return counted.select("source_id", F.col("w.start").alias("start"), "severity", "n")


def live_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Contexts as session windows: first and last time, events, worst severity."""
    grouped = events.where(F.col("context").isNotNull()).withWatermark("ts", late).groupBy("source_id", "context", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max("severity").alias("severity")).select("source_id", "context", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n", "severity")
