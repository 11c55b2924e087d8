"""NDJSON folders as streams of nodes, and counts over windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.documents import nodes


def node_stream(spark: SparkSession, folder: str, on_error: str = "skip", files_at_once: int | None = None) -> DataFrame:
    """The nodes of the records that arrive in a folder of NDJSON files; a record is named by its file and text, as lines of a stream have no number."""
    reader = spark.readStream if files_at_once is None else spark.readStream.option("maxFilesPerTrigger", files_at_once)
    lines = reader.text(folder).select(F.col("_metadata.file_path").alias("doc"), F.xxhash64("value").alias("rec"), F.col("value").alias("text"))
    return nodes.shred(lines.where(F.trim("text") != ""), on_error=on_error)


def windowed(events: DataFrame, time: str, width: str, late: str, by: list[str], value: str | None = None) -> DataFrame:
    """(window_start, window_end, by..., n, total) of tumbling windows of event time; events later than `late` behind the newest one are dropped, and their state with them."""
    at = F.window(F.col(time), width)
    sums = [F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else [])]
    out = events.withWatermark(time, late).groupBy(at.alias("w"), *by).agg(*sums)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", *(["total"] if value else []))
