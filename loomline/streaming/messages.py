"""Streaming forms of the row-local stages and of the activity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.mime import parse_messages
from loomline.operators import content

RAW = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("seq", T.LongType()), ("filename", T.StringType()), ("raw_text", T.StringType()))])


def read_raw(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New JSON-lines files of raw messages in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def parsed_stream(raw: DataFrame) -> DataFrame:
    rows = raw.select("id", "seq", F.col("filename").alias("source_filename"), "raw_text")
    return parse_messages(rows, "raw_text")


def processed_stream(parsed: DataFrame) -> DataFrame:
    """Content records; the stage keeps no state."""
    return content.process(parsed)


def hourly_counts(events: DataFrame, ts: str = "ts", late: str = "2 hours", *by: str) -> DataFrame:
    """Counts by hour, final once the watermark has passed it."""
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), *by).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("window.start").alias("hour_start"), *by, "n")
