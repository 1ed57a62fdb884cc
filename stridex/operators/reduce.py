"""Reductions: whole, by segment, with positions, sparse matrix-vector product, and a robust mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridex.plans.tables import cut

#: What an empty segment reduces to, for 32-bit values.
INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
IDENTITY = {"sum": 0, "min": INT_MAX, "max": INT_MIN}
#: Bits of a row number that each level of a reduction folds away.
LEVEL_BITS, LEVELS = 13, 3


def _wide(df: DataFrame, value: str) -> Column:
    return F.col(value).cast("long") if df.schema[value].dataType.typeName() in ("byte", "short", "integer") else F.col(value)


def reduce(df: DataFrame, value: str) -> DataFrame:
    """One row: sum, min, max, n."""
    v = _wide(df, value)
    return df.agg(F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))


def reduce_by(df: DataFrame, value: str, combine: Callable[[Column, Column], Column], init: Column | None = None) -> DataFrame:
    """One row, ``result``: any commutative and associative operation over all values that aren't null, and ``init`` once.

    Rows are folded by thousands, in levels, by their number in their partition, so a list is short
    whatever the values.  Without values the result is ``init``, or null without one.
    """

    def folded(c: Column) -> Column:
        rows = F.collect_list(c)
        return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, 0), combine)

    part = df.select(F.col(value).alias("x"), F.monotonically_increasing_id().alias("g"))
    for _ in range(LEVELS):
        part = part.groupBy(F.shiftright("g", LEVEL_BITS).alias("g")).agg(folded(F.col("x")).alias("x"))
    last = part.agg(folded(F.col("x")).alias("result"))
    return last if init is None else last.select(F.when(F.col("result").isNull(), init).otherwise(combine(init, F.col("result"))).alias("result"))


def argmin(df: DataFrame, value: str, pos: str) -> DataFrame:
    """One row: key (the least position of the least value) and value; nulls for an empty input."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(pos).alias("p")))
    return df.where(F.col(value).isNotNull()).agg(best.alias("b")).select(F.col("b.p").alias("key"), F.col("b.v").alias("value"))


def argmax(df: DataFrame, value: str, pos: str) -> DataFrame:
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(pos)).alias("p")))
    return df.where(F.col(value).isNotNull()).agg(best.alias("b")).select((-F.col("b.p")).alias("key"), F.col("b.v").alias("value"))


def segmented_reduce(df: DataFrame, segments: DataFrame, segment: str, value: str) -> DataFrame:
    """segment, sum, min, max, n for every row of ``segments``; an empty segment has the identities."""
    v = _wide(df, value)
    sums = df.groupBy(segment).agg(F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    joined = segments.select(segment).distinct().join(sums, segment, "left")
    return joined.select(segment, *[F.coalesce(op, F.lit(x).cast("long")).alias(op) for op, x in IDENTITY.items()], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def segmented_arg(df: DataFrame, segments: DataFrame, segment: str, value: str, offset: str, smallest: bool = True) -> DataFrame:
    """segment, key, value: the extreme value and its least offset within the segment; (1, INT_MAX or INT_MIN) if empty."""
    sign = 1 if smallest else -1
    pick = F.min if smallest else F.max
    best = pick(F.struct(F.col(value).alias("v"), (sign * F.col(offset)).alias("p")))
    found = df.groupBy(segment).agg(best.alias("b"))
    empty = INT_MAX if smallest else INT_MIN
    joined = segments.select(segment).distinct().join(found, segment, "left")
    return joined.select(segment, F.coalesce(sign * F.col("b.p"), F.lit(1)).cast("long").alias("key"), F.coalesce(F.col("b.v"), F.lit(empty)).cast("long").alias("value"))


def tile_sums(df: DataFrame, value: str, pos: str, tile: int) -> DataFrame:
    """tile, total: the first step of a reduce-then-scan."""
    return df.groupBy(F.floor(F.col(pos) / tile).alias("tile")).agg(F.sum(_wide(df, value)).alias("total"))


def odd_counts(df: DataFrame, value: str, pos: str, tile: int) -> DataFrame:
    """tile, odd: the number of odd values in each tile."""
    return df.groupBy(F.floor(F.col(pos) / tile).alias("tile")).agg(F.sum(F.col(value).cast("long").bitwiseAND(F.lit(1).cast("long"))).alias("odd"))


def spmv(matrix: DataFrame, vector: DataFrame, rows: DataFrame | int | None = None) -> DataFrame:
    """row, y of y = A x.  matrix: row, col, val (repeated entries add up); vector: col, x.

    ``rows`` (a table of ``row``, or the number of rows from 0) says which rows A has; one without
    entries has y = 0.  Without it, rows without entries are absent.
    """
    y = matrix.join(vector, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))
    if rows is None:
        return y
    every = matrix.sparkSession.range(rows).select(F.col("id").alias("row")) if isinstance(rows, int) else rows.select("row").distinct()
    return every.join(y, "row", "left").select("row", F.coalesce("y", F.lit(0).cast(y.schema["y"].dataType)).alias("y"))


def median(df: DataFrame, value: str, at_once: int = 1_000_000) -> float | None:
    """The exact median (the mean of the middle pair), None for no values.

    Spark's exact median holds every distinct value in one task.  Here approximate percentiles, whose
    error is bounded, narrow a bracket around the middle until so few values are left that one task
    may rank them.  The first bracket, some hundredths of the rows, is written down, so the source is
    read twice at most.
    """
    cur = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    near = lambda low, high: F.percentile_approx("x", [max(0.0, low - 0.01), min(1.0, high + 0.01)], 10_000)
    left, (low, high) = (lambda r: (r[0], r[1] or (None, None)))(cur.agg(F.count("x"), near(0.5, 0.5)).first())
    if not left:
        return None
    low_rank, high_rank, source = (left - 1) // 2, left // 2, True
    while left > at_once:
        if low == high:
            return low
        inside = (F.col("x") >= low) & (F.col("x") <= high)
        below, kept = cur.agg(F.count(F.when(F.col("x") < low, 1)), F.count(F.when(inside, 1))).first()
        if kept == left:
            break
        cur, source = cut(cur.where(inside), "bracket") if source else cur.where(inside), False
        left, low_rank, high_rank = kept, low_rank - below, high_rank - below
        if left > at_once:
            low, high = cur.agg(near(low_rank / left, high_rank / left)).first()[0]
    # Equal values are one row, so ties can't make the last step large.
    counts = cur.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    pair = upto.agg(*[F.min(F.when(F.col("upto") > k, F.col("x"))) for k in (low_rank, high_rank)]).first()
    return (pair[0] + pair[1]) / 2


def hampel_mean(df: DataFrame, value: str, cutoff: float = 3.5) -> DataFrame:
    """One row, ``mean``: of the values within ``cutoff`` of the median in units of MAD / 0.6745; if MAD is 0, of those equal to the median."""
    x = F.col(value).cast("double")
    middle = median(df, value)
    if middle is None:
        return df.agg(F.avg(x).alias("mean"))
    away = df.select(x.alias("x"), F.abs(x - F.lit(middle)).alias("d"))
    mad = median(away, "d")
    kept = away.where(F.col("d") == 0 if mad == 0 else F.col("d") * 0.6745 / F.lit(mad) <= cutoff)
    return kept.agg(F.avg("x").alias("mean"))
