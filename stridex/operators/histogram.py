"""Bin histograms: even bins and explicit levels, for one channel or several, over one or two dimensions of bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Number of the even bin of [low, high) that x lies in; null outside."""
    width = (high - low) / bins
    return F.when((x >= low) & (x < high), F.least(F.floor((x - low) / F.lit(width)), F.lit(bins - 1))).cast("int")


#: More levels than this are searched in an array, so that the expression stays small.
NESTED_LEVELS = 64


def range_bin(x: Column, levels: list[float]) -> Column:
    """Number of the bin [levels[i], levels[i + 1]) that x lies in; null outside.  By halving the levels."""
    if sorted(levels) != list(levels) or len(levels) < 2:
        raise ValueError("levels must ascend")

    def search(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(x < levels[m], search(a, m)).otherwise(search(m, b))

    def searched() -> Column:
        held = F.lit(list(levels))
        # The bin lies in [at, at + width): each step halves the width.
        steps = [1 << k for k in range((len(levels) - 2).bit_length() - 1, -1, -1)]
        step = lambda at, width: F.when(F.coalesce(F.get(held, at + width) <= x, F.lit(False)), at + width).otherwise(at)
        return F.aggregate(F.lit(steps), F.lit(0), step)

    found = search(0, len(levels) - 1) if len(levels) <= NESTED_LEVELS else searched()
    return F.when((x >= levels[0]) & (x < levels[-1]), found).cast("int")


def counted(df: DataFrame, where: Column, bins: int) -> DataFrame:
    counts = df.select(where.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram_even(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return counted(df, even_bin(F.col(value), low, high, bins), bins)


def histogram_range(df: DataFrame, value: str, levels: list[float]) -> DataFrame:
    return counted(df, range_bin(F.col(value), levels), len(levels) - 1)


def multi_histogram(df: DataFrame, bins_of: dict[str, tuple[Column, int]]) -> DataFrame:
    """channel, bin, n: one histogram a channel, in one pass over the rows.  bins_of: channel -> (bin column, bins)."""
    picked = F.array(*[F.struct(F.lit(c).alias("channel"), b.alias("bin")) for c, (b, _) in bins_of.items()])
    counts = df.select(F.explode(picked).alias("p")).where("p.bin IS NOT NULL").groupBy("p.channel", "p.bin").agg(F.count(F.lit(1)).alias("n"))
    spark, every = df.sparkSession, None
    for c, (_, n) in bins_of.items():
        part = spark.range(n).select(F.lit(c).alias("channel"), F.col("id").cast("int").alias("bin"))
        every = part if every is None else every.union(part)
    return every.join(counts, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def region(df: DataFrame, row: str, column: str, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The samples of a two-dimensional region of interest."""
    return df.where((F.col(row) >= rows[0]) & (F.col(row) < rows[1]) & (F.col(column) >= columns[0]) & (F.col(column) < columns[1]))
