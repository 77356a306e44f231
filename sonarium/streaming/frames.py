"""Pipelines over streams: frames that arrive are taken through the same operations as stored ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.operators import frames
from sonarium.sources.tensors import BLOCK


def block_stream(spark: SparkSession, path: str, files_at_once: int = 16) -> DataFrame:
    """Block tables as they are written to a folder."""
    return spark.readStream.schema(BLOCK).option("maxFilesPerTrigger", files_at_once).parquet(path)


def framed(stream: DataFrame, steps: list[Callable]) -> DataFrame:
    """A stream of frames taken through whole-frame steps; nothing is kept from one frame to the next."""
    return frames.on_frames(stream, steps)


def windowed(stream: DataFrame, time: str, value: str, by: list[str], width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, sum and extremes a window of event time and group. Times without a zone are taken as UTC; rows later
    than the watermark are dropped, and a window comes out when it has passed."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    made = timed.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total", "least", "most")


def sessions(stream: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: rows no further apart than the gap."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    made = timed.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return made.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
