"""Selection and two-way partition, with explicit output positions.  Positions may have gaps and start anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridex.operators.scan import scan_tiles
from stridex.operators.tiles import TILE, fresh, met, tile_of


def _places(df: DataFrame, predicate: Column, pos: str, tile: int) -> tuple[DataFrame, str, Column, Column]:
    """Rows with their hit (0 or 1), the hit's name, and how many hits and rows come before each."""
    hit, at, hits, rows = fresh(df.columns, "hit", "tile", "hits", "rows")
    marked = df.withColumns({hit: F.coalesce(predicate, F.lit(False)).cast("long"), at: tile_of(pos, tile)})
    found, ahead = scan_tiles(marked, at, [], pos, {hits: (F.col(hit), "sum"), rows: (F.lit(1), "count")})
    return found, hit, *(F.coalesce(ahead[c], F.lit(0).cast("long")) for c in (hits, rows))


def select_if(df: DataFrame, predicate: Column, pos: str, out: str = "out_pos", tile: int = TILE) -> DataFrame:
    """The rows where the predicate holds, with their new positions."""
    found, hit, hits, _ = _places(df, predicate, pos, tile)
    return found.withColumn(out, hits).where(F.col(hit) == 1).select(*dict.fromkeys([*df.columns, out]))


def partition_if(df: DataFrame, predicate: Column, pos: str, out: str = "out_pos", tile: int = TILE) -> DataFrame:
    """All rows: those selected in front in order, the others behind in reverse order, with ``selected``."""
    found, hit, hits, rows = _places(df, predicate, pos, tile)
    n, = fresh([*found.columns, "selected", out], "n")
    # A row that isn't selected stands as far from the end as there are others before it.
    met_rows = found.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(n))), F.lit(True))
    placed = met_rows.withColumn(out, F.when(F.col(hit) == 1, hits).otherwise(F.col(n) - 1 - (rows - hits)))
    return placed.withColumn("selected", F.col(hit) == 1).select(*dict.fromkeys([*df.columns, "selected", out]))


def _flagged(df: DataFrame, flags: DataFrame, pos: str, flag: str) -> tuple[DataFrame, str]:
    name, = fresh([*df.columns, *flags.columns], "flag")
    return met(df, flags.select(pos, F.col(flag).cast("boolean").alias(name)), [pos], [name]), name


def select_flagged(df: DataFrame, flags: DataFrame, pos: str, flag: str = "flag", out: str = "out_pos") -> DataFrame:
    """The rows whose flag, found by position, is set."""
    found, name = _flagged(df, flags, pos, flag)
    return select_if(found, F.col(name), pos, out).drop(name)


def partition_flagged(df: DataFrame, flags: DataFrame, pos: str, flag: str = "flag", out: str = "out_pos") -> DataFrame:
    found, name = _flagged(df, flags, pos, flag)
    return partition_if(found, F.col(name), pos, out).drop(name)


def in_range(pos: Column, low: int, high: int) -> Column:
    return (pos >= low) & (pos < high)
