"""Popularity as a stream: counts by article and window, kept up as events come; an extension beyond batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """article_id, start, exposures, clicks by window; events later than the watermark are dropped."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("article_id"), F.col("event_type").isin("click", "purchase").cast("int").alias("label"))
    g = e.withWatermark("ts", late).groupBy(F.window("ts", window), "article_id").agg(F.count("*").alias("exposures"), F.sum("label").alias("clicks"))
    return g.select("article_id", F.col("window.start").alias("start"), "exposures", "clicks")


def start(events: DataFrame, path: str, checkpoint: str, **options):
    """Closed windows appended to Parquet under path, once; restarts go on from the checkpoint."""
    return windowed(events, **options).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
