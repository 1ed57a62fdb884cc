"""Split: rows to buckets with explicit output positions, and the histograms that give them.

The layout is bucket-major: a bucket's rows stand together, in input order.  A row's position is its
bucket's start, plus the rows of its bucket in earlier tiles, plus its rank in its own tile, so the
largest bucket is spread over as many tasks as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridex.functions.scalar import bucket as low_bits
from stridex.functions.scalar import check_power_of_two
from stridex.operators.tiles import TILE, fresh


def histogram(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucket, n for every bucket, those without rows included."""
    check_power_of_two(buckets)
    counts = df.groupBy(low_bits(F.col(key), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bucket_starts(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """bucket, start: the first output position of each bucket.  One row a bucket goes through one task."""
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return histogram(df, key, buckets).select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("start"))


def place(df: DataFrame, bucket: str, order: str, out: str = "pos", tile: int = TILE) -> DataFrame:
    """``df`` with the output position of each row; ``order`` is unique, and may have gaps."""
    at, b, start, n, size, offset = fresh([*df.columns, out], "tile", "b", "start", "n", "size", "offset")
    # The filter is said once for all branches, so that they share one count exchange; rows without bucket or position have no place.
    tiled = df.withColumn(at, F.floor(F.col(order) / tile)).where(F.col(bucket).isNotNull() & F.col(at).isNotNull())
    counts = tiled.groupBy(bucket, at).agg(F.count(F.lit(1)).alias(n))
    sizes = counts.groupBy(bucket).agg(F.sum(n).alias(size))
    starts = sizes.select(F.col(bucket).alias(b), F.coalesce(F.sum(size).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    earlier = F.coalesce(F.sum(n).over(Window.partitionBy(bucket).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn(offset, earlier).join(starts, F.col(bucket) == F.col(b)).select(bucket, at, (F.col(start) + F.col(offset)).alias(offset))
    rank = F.row_number().over(Window.partitionBy(bucket, at).orderBy(order)) - 1
    return tiled.join(offsets, [bucket, at]).withColumn(out, (F.col(offset) + rank).cast("long")).select(*dict.fromkeys([*df.columns, out]))


def split(df: DataFrame, key: str, order: str, buckets: int, values: list[str] | None = None, layout: str = "soa", bucket: Column | None = None, tile: int = TILE) -> DataFrame:
    """bucket, pos, key and the value columns.

    ``values`` none: keys alone.  ``layout`` aos packs key and values into one struct ``t``.
    ``bucket`` replaces the low bits of the key by any expression with values from 0 to buckets - 1.
    """
    if layout not in ("soa", "aos"):
        raise ValueError(f"unknown layout {layout}")
    where = bucket if bucket is not None else low_bits(F.col(key), buckets)
    if bucket is not None:
        where = F.when((where >= 0) & (where < buckets), where).otherwise(F.raise_error(F.lit("bucket out of range"))).cast("int")
    columns = [key, *(values or [])]
    placed = place(df.select(*dict.fromkeys([order, *columns]), where.alias("bucket")), "bucket", order, tile=tile)
    packed = [F.struct(*columns).alias("t")] if layout == "aos" else columns
    return placed.select("bucket", "pos", *packed)


def multisplit(df: DataFrame, key: str, order: str, buckets: int, tile: int = TILE) -> DataFrame:
    """Split where keys are bucket ids."""
    return split(df, key, order, buckets, bucket=F.col(key), tile=tile)
