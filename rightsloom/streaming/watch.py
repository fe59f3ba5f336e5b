"""Directory watch: new files, each content once, rolled up by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import container_format


def watch_files(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Stream of path, modificationTime, format, digest: of equal contents within the delay the first stays."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder).withWatermark("modificationTime", delay)
    seen = files.select("path", "modificationTime", container_format(F.col("content")).alias("format"), F.sha2("content", 256).alias("digest"))
    return seen.dropDuplicatesWithinWatermark(["digest"])


def arrivals(files: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Files by window and format."""
    return files.groupBy(F.window("modificationTime", window), "format").count()


def event_rates(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream in sliding windows; late rows beyond the delay are left out."""
    by = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
