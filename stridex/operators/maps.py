"""Element-wise maps over a relation: each adds or replaces one column and moves no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridex.functions import scalar


def transform(df: DataFrame, value: str, function: Callable[[Column], Column], out: str = "out") -> DataFrame:
    return df.withColumn(out, function(F.col(value)))


def copy(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def scale(df: DataFrame, value: str, factor: int = 3, out: str = "out") -> DataFrame:
    return df.withColumn(out, scalar.scale(F.col(value), factor))


def add(df: DataFrame, a: str, b: str, out: str = "out") -> DataFrame:
    return df.withColumn(out, scalar.add(F.col(a), F.col(b)))


def triad(df: DataFrame, a: str, b: str, factor: int = 3, out: str = "out") -> DataFrame:
    return df.withColumn(out, scalar.triad(F.col(a), F.col(b), factor))


def add_relations(left: DataFrame, right: DataFrame, pos: str, value: str, out: str = "out") -> DataFrame:
    """The sum of two arrays by position."""
    met = left.select(pos, F.col(value).alias("__a")).join(right.select(pos, F.col(value).alias("__b")), pos)
    return met.select(pos, scalar.add(F.col("__a"), F.col("__b")).alias(out))
