"""Scalar column functions: masks, digits, powers of two, and the arithmetic of the element-wise maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_power_of_two(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"{n} is not a power of two")
    return n


def bucket(key: Column, buckets: int) -> Column:
    """The low bits of a key: key & (buckets - 1), which is never negative; ``buckets`` must be a power of two."""
    return key.cast("long").bitwiseAND(F.lit(check_power_of_two(buckets) - 1).cast("long")).cast("int")


def digit(key: Column, begin_bit: int, bits: int) -> Column:
    """``bits`` bits of a key from ``begin_bit`` up."""
    return F.shiftrightunsigned(key.cast("long"), begin_bit).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def floor_power_of_two(x: Column) -> Column:
    """The largest power of two strictly below x; 0 for x <= 1.  Fractions are dropped first."""
    n = x.cast("long")
    return F.when(n <= 1, F.lit(0).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1)) - 1).cast("long"))


def ceil_power_of_two(x: Column) -> Column:
    """The smallest power of two that is at least x; 1 for x <= 1."""
    n = x.cast("long")
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))


def exact_log2(x: Column) -> Column:
    """The exponent of a power of two, -1 for any other number."""
    n = x.cast("long")
    return F.when((n > 0) & (F.bit_count(n) == 1), F.length(F.bin(n)) - 1).otherwise(F.lit(-1)).cast("int")


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def scale(x: Column, factor: int = 3) -> Column:
    return x.cast("long") * F.lit(factor)


def add(a: Column, b: Column) -> Column:
    return a.cast("long") + b.cast("long")


def triad(a: Column, b: Column, factor: int = 3) -> Column:
    return a.cast("long") + F.lit(factor) * b.cast("long")


def increment(x: Column) -> Column:
    return x.cast("long") + 1


def heavy_sum(x: Column, k: int) -> Column:
    """int(4 * sum of (i + x) / (2k * 0.29 + 1.33) for i = 0..k), in closed form."""
    return (((k + 1) * x.cast("double") + k * (k + 1) / 2) * 4 / (0.58 * k + 1.33)).cast("int")


def repeated_fma(s: Column, times: int) -> Column:
    """s = s * 1.0001 + 1.0001, so many times over."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), s.cast("double"), lambda a, _: a * 1.0001 + 1.0001)


def as_text(x: Column) -> Column:
    return x.cast("string")


def gibibytes_per_second(items: Column, word_bytes: Column, milliseconds: Column) -> Column:
    """items * word_bytes / 2^30 per second."""
    return items * word_bytes / F.lit(float(1 << 30)) / milliseconds * 1000
