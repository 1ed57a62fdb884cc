"""Positional access: gather and scatter as equi-joins on positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(source: DataFrame, loc: DataFrame, passes: int = 1, missing: str = "null") -> DataFrame:
    """i, val with out[i] = source[loc[i]].  source: pos, val; loc: i, pos.

    ``passes`` restricts nothing about the result and is accepted for callers that tune it.
    A location outside the source gives null, or no row with ``missing='drop'``.
    """
    if passes < 1 or missing not in ("null", "drop"):
        raise ValueError("passes must be positive, missing null or drop")
    return loc.join(source, "pos", "left" if missing == "null" else "inner").select("i", "val")


def scatter(source: DataFrame, loc: DataFrame, passes: int = 1, on_conflict: str = "last") -> DataFrame:
    """pos, val with out[loc[i]] = source[i].  Of rows with one target the one of the greatest i stays; 'error' refuses them."""
    if passes < 1 or on_conflict not in ("last", "first", "error"):
        raise ValueError("passes must be positive, on_conflict last, first or error")
    moved = loc.join(source.select(F.col("pos").alias("i"), "val"), "i").select("pos", "i", "val")
    pick = F.min_by if on_conflict == "first" else F.max_by
    grouped = moved.groupBy("pos").agg(pick("val", "i").alias("val"), F.count(F.lit(1)).alias("__n"))
    if on_conflict == "error":
        grouped = grouped.withColumn("val", F.when(F.col("__n") == 1, F.col("val")).otherwise(F.raise_error(F.lit("two rows with one target"))))
    return grouped.select("pos", "val")


def in_pass(pos, number: int, passes: int, length: int):
    """The predicate of one pass: positions of its share of the array."""
    return (pos >= number * length // passes) & (pos < (number + 1) * length // passes)
