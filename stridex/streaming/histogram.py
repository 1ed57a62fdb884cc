"""Streaming counts: the bucket histogram of rows as they arrive, whole or by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridex.functions.scalar import bucket


def bucket_counts(stream: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucket, n so far; state holds one row a bucket."""
    return stream.groupBy(bucket(F.col(key), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, key: str, buckets: int, time: str, width: str, lateness: str) -> DataFrame:
    """start, bucket, n by tumbling windows; rows later than ``lateness`` are dropped, as are windows from the state."""
    windowed = stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), bucket(F.col(key), buckets).alias("bucket"))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "bucket", "n")
