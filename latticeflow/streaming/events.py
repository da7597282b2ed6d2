"""Streaming forms of the counting operators.  The reference has none; these go beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*").parquet(folder)


def windowed_counts(events: DataFrame, time: str, by: str, value: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and category; rows later than the watermark are left out, state is dropped behind it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def streaming_histogram(events: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, freq) over a range that is given: state is one row for each bucket."""
    place = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(buckets * (F.col(value) - low) / (high - low)))).cast("int")
    return events.where(F.col(value).isNotNull()).groupBy(place.alias("bucket")).agg(F.count("*").alias("freq"))
