"""Messages in Structured Streaming: readers and writers are stateless row functions, so they run unchanged in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xmlframe.engine import CompiledReader
from xmlframe.workers import ship


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of whole files: (path, xml)."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def read_stream(stream: DataFrame, reader: CompiledReader, xml: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns and ``errors`` for every message of a stream; a bad message never stops it."""
    ship(stream.sparkSession)
    return reader.frame(stream, xml, "PERMISSIVE", keep)


def error_rates(read: DataFrame, time: str, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Messages and broken messages for each window of event time; late ones count until the watermark passes."""
    broken: Column = (F.size("errors") > 0).cast("bigint")
    windows = read.withWatermark(time, late).groupBy(F.window(time, every).alias("w"))
    return windows.agg(F.count(F.lit(1)).alias("messages"), F.sum(broken).alias("broken")).select("w.start", "w.end", "messages", "broken")
