"""Equi-joins by strategy, nested-loop joins, and their counting forms.

The strategy is a hint: ``auto`` leaves the choice to Spark, which knows sizes; ``broadcast`` asks
for a broadcast only where the build side, unpacked, is within a bound in bytes, and otherwise falls
back to a shuffled hash join.  The plan's size estimate is looked at first, and no job is run where
that is above the bound.  Below it the rows are counted, as files can be far smaller than their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType, VariantType

from stridex.operators.tiles import fresh

HINTS = {"auto": None, "broadcast": "broadcast", "partitioned": "shuffle_hash", "merge": "merge"}
#: Bytes in memory up to which a side may be broadcast: the driver holds it, and each executor a copy.
BROADCAST_BYTES = 64 << 20
#: Bytes that a row of a broadcast table takes besides its columns.
ROW_BYTES = 56


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer thinks the rows take; very large where it can't tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, limit: int) -> bool:
    """Whether the rows take at most ``limit`` bytes in memory.  One aggregation, which reads no columns but strings; False for nested columns."""
    if estimated_bytes(df) > limit:
        return False
    kinds = [f.dataType for f in df.schema]
    if any(isinstance(t, ArrayType | MapType | StructType | VariantType) for t in kinds):
        return False
    # By place, as names may repeat.
    named = df.toDF(*(f"c{k}" for k in range(len(kinds))))
    texts = [F.coalesce(F.sum(F.octet_length(f"c{k}")), F.lit(0)) for k, t in enumerate(kinds) if isinstance(t, StringType | BinaryType)]
    row = named.agg(F.count(F.lit(1)), *texts).first()
    return row[0] * (ROW_BYTES + 8 * len(kinds)) + sum(row[1:]) <= limit


def hash_join(build: DataFrame, probe: DataFrame, key: str | list[str], strategy: str = "auto", how: str = "inner", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """probe joined with build on key; duplicates on both sides multiply, null keys meet nothing."""
    if strategy not in HINTS:
        raise ValueError(f"unknown strategy {strategy}")
    hint = HINTS[strategy]
    if hint == "broadcast" and not fits(build, broadcast_bytes):
        hint = "shuffle_hash"
    return probe.join(build.hint(hint) if hint else build, key, how)


def count_matches(build: DataFrame, probe: DataFrame, key: str | list[str], strategy: str = "auto") -> DataFrame:
    """One row, ``matches``.  Both sides are counted by key before they meet, so a hot key costs one row."""
    keys = [key] if isinstance(key, str) else key
    b, p = fresh(keys, "b", "p")
    side = lambda df, n: df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    met = hash_join(side(build, b), side(probe, p), keys, strategy)
    return met.agg(F.coalesce(F.sum(F.col(b) * F.col(p)), F.lit(0)).cast("long").alias("matches"))


def nested_loop_join(outer: DataFrame, inner: DataFrame, condition: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join on any condition: the inner side goes whole to every task if it is small, else the sides meet block by block.

    Work grows with the product of the sides; ``band_join`` serves ranges in less.
    """
    return outer.join(F.broadcast(inner) if fits(inner, broadcast_bytes) else inner, condition)


def indexed_join(outer: DataFrame, position: str, source: DataFrame) -> DataFrame:
    """Each outer row with the source row at its position (source: pos and other columns)."""
    return outer.join(source, outer[position] == source["pos"]).drop(source["pos"])


def band_join(left: DataFrame, right: DataFrame, on: str, low: str, high: str, width: int) -> DataFrame:
    """left rows whose ``on`` lies in right's [low, high): both sides are dealt by bands of ``width``, so no side is copied whole."""
    band, = fresh([*left.columns, *right.columns], "band")
    bands = right.where(F.col(low) < F.col(high)).withColumn(band, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return left.withColumn(band, F.floor(F.col(on) / width)).join(bands, band).where((F.col(on) >= F.col(low)) & (F.col(on) < F.col(high))).drop(band)
