"""Generated inputs: random integers, permutations, constants and counters, all distributed and repeatable."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counting(spark: SparkSession, length: int, start: int = 0) -> DataFrame:
    return spark.range(length).select(F.col("id").alias("pos"), (F.col("id") + start).alias("val"))


def constant(spark: SparkSession, length: int, value: int) -> DataFrame:
    return spark.range(length).select(F.col("id").alias("pos"), F.lit(value).alias("val"))


def uniform(spark: SparkSession, length: int, bound: int, seed: int = 1234) -> DataFrame:
    """Integers from 0 to bound - 1, from a hash of position and seed: the same however the rows are dealt."""
    return spark.range(length).select(F.col("id").alias("pos"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(bound)).cast("int").alias("val"))


def permutation(spark: SparkSession, length: int, multiplier: int = 7, shift: int = 3) -> DataFrame:
    """i -> (multiplier * i + shift) mod length, a permutation as the multiplier is coprime to the length."""
    while gcd(multiplier, max(length, 1)) != 1:
        multiplier += 1
    return spark.range(length).select(F.col("id").alias("i"), ((F.col("id") * multiplier + shift) % max(length, 1)).alias("pos"))
