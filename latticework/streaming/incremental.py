"""Incremental histograms: weighted counts add up, so a stream of observations can keep them current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_histogram(rows: DataFrame, keys: list[str], bins: list[str], weight: str | None = None) -> DataFrame:
    """A streaming (keys, bins, w); for update or complete mode."""
    known = rows.dropna(subset=[*keys, *bins])
    return known.groupBy(*keys, *bins).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"))


def windowed_histogram(rows: DataFrame, time: str, late: str, width: str, keys: list[str], bins: list[str]) -> DataFrame:
    """Counts in time windows, final once the watermark has passed; for append mode."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys, *bins).agg(F.sum(F.lit(1.0)).alias("w"))


def to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode counts as Parquet, exactly once; stops when the source is read."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
