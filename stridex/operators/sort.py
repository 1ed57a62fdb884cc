"""Sorts with an explicit rank, as row order is no part of a DataFrame's contract.

``range`` sorts by range partitions: rows are dealt to ranges of the key once and written, and a
row's rank is the size of the ranges before its own plus its place there.  Writing is a job of its
own, run when the sort is called, as ranges rest on a sample and must not change between two uses.
``window`` ranks in one partition, or a segment in one task.  Ranks are 64-bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridex.functions.scalar import digit
from stridex.operators.tiles import fresh, met
from stridex.plans.tables import cut


def _order(key: Column, descending: bool) -> Column:
    return key.desc_nulls_last() if descending else key.asc_nulls_first()


def _place(keys: list[str], order: list[Column]) -> Column:
    # A count is 64-bit, where row_number is not.
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1


def _ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, strategy: str, ranges: int | None) -> DataFrame:
    """``df`` with the rank of each row in the order of ``order``, among the rows with its ``keys``."""
    if strategy not in ("range", "window"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "window":
        return df.withColumn(out, _place(keys, order))
    at, ahead = fresh([*df.columns, out], "range", "ahead")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By the keys first, so that rows of one key stand in few ranges, and a key that holds most rows in many.
    dealt = cut(df.repartitionByRange(n, *keys, *order).withColumn(at, F.spark_partition_id()), "sorted")
    sizes = dealt.groupBy(*keys, at).agg(F.count(F.lit(1)).alias(ahead))
    earlier = F.coalesce(F.sum(ahead).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = met(dealt, sizes.withColumn(ahead, earlier), [*keys, at], [ahead])
    return rows.withColumn(out, F.col(ahead) + _place([*keys, at], order)).drop(at, ahead)


def sort(df: DataFrame, key: str, tie: str, descending: bool = False, out: str = "rank", strategy: str = "range", ranges: int | None = None, by: Column | None = None) -> DataFrame:
    """``df`` with the rank of each row by ``key`` (or the expression ``by``), ties in the order of ``tie``."""
    name, = fresh([*df.columns, out], "key")
    tagged = df.withColumn(name, by if by is not None else F.col(key))
    ranked = _ranked(tagged, [], [_order(F.col(name), descending), F.col(tie).asc()], out, strategy, ranges)
    return ranked.select(*dict.fromkeys([*df.columns, out]))


def sort_bits(df: DataFrame, key: str, tie: str, begin_bit: int, end_bit: int, **options) -> DataFrame:
    """Rank by some bits of the key alone."""
    return sort(df, key, tie, by=digit(F.col(key), begin_bit, end_bit - begin_bit), **options)


def sort_unsigned(df: DataFrame, key: str, tie: str, **options) -> DataFrame:
    """Rank with negative keys after all others, as their unsigned forms are."""
    return sort(df, key, tie, by=F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), **options)


def segmented_sort(df: DataFrame, segment: str, key: str, tie: str, descending: bool = False, out: str = "rank", strategy: str = "range", ranges: int | None = None) -> DataFrame:
    """The rank of each row within its segment.  With ``range`` a segment of any size is spread over ranges."""
    ranked = _ranked(df, [segment], [_order(F.col(key), descending), F.col(tie).asc()], out, strategy, ranges)
    return ranked.select(*dict.fromkeys([*df.columns, out]))


def digit_rank(df: DataFrame, block: str, key: str, tie: str, begin_bit: int, bits: int, out: str = "rank") -> DataFrame:
    """Stable rank of each key by one digit within its block."""
    return df.withColumn(out, _place([block], [digit(F.col(key), begin_bit, bits).asc(), F.col(tie).asc()]))


def top(df: DataFrame, key: str, tie: str, count: int, descending: bool = True) -> DataFrame:
    """The first ``count`` rows; each task sends no more than that."""
    return df.orderBy(_order(F.col(key), descending), F.col(tie).asc()).limit(count)
