"""Runs of equal neighbours: flags, run ids, unique, run-length encoding, reduce by key, differences, shifts.

Neighbours are the rows next in order, in the whole array or a segment, whatever gaps the positions
have.  They come by a window inside each tile, and across tiles from one row a tile, so no task
holds the array or a segment.  Rows with a null position stand before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridex.operators.scan import scan_tiles
from stridex.operators.tiles import TILE, before, fresh, met, tile_of


def _keys(segment: str | None) -> list[str]:
    return [segment] if segment else []


def _neighbour(tiled: DataFrame, tile: str, keys: list[str], held: str, order: str, out: str, after: bool = False) -> DataFrame:
    """``tiled`` with ``held`` (a struct, so never null itself) of the row before each row, or after it; null where there is none."""
    edge, = fresh([*tiled.columns, out], "edge")
    pick = F.min_by if after else F.max_by
    # Within a struct, a null position is ordered too.
    edges = tiled.groupBy(*keys, tile).agg(pick(F.col(held), F.struct(order)).alias(edge))
    near = before(edges, keys, tile, {edge: (lambda c: F.last(c, ignorenulls=True), pick, lambda further, nearer: nearer)}, backward=after)
    window = Window.partitionBy(*keys, tile).orderBy(order)
    inside = F.lead(held, 1).over(window) if after else F.lag(held, 1).over(window)
    rows = met(tiled, near, [*keys, tile], [edge])
    return rows.withColumn(out, F.coalesce(inside, F.col(edge))).drop(edge)


def shift(df: DataFrame, value: str, pos: str, by: int, out: str, segment: str | None = None, rotate: bool = False, dense: bool = False, tile: int = TILE) -> DataFrame:
    """``df`` with the value ``by`` places before (after if negative); null beyond the end, or from the other end with ``rotate``.

    ``dense`` says that positions are 0, 1, 2 and so on, which saves finding each row's place.
    """
    if rotate and segment:
        raise ValueError("a rotation is of the whole array")
    keys, columns = _keys(segment), list(dict.fromkeys([*df.columns, out]))
    at, held, place, target, n, found = fresh([*columns], "tile", "held", "place", "target", "n", "found")
    if abs(by) == 1 and not rotate:
        tiled = df.withColumns({at: tile_of(pos, tile), held: F.struct(F.col(value).alias("v"))})
        return _neighbour(tiled, at, keys, held, pos, found, by < 0).withColumn(out, F.col(f"{found}.v")).select(*columns)
    if dense and not segment:
        placed = df.withColumn(place, F.col(pos).cast("long"))
    else:
        rows, ahead = scan_tiles(df.withColumn(at, tile_of(pos, tile)), at, keys, pos, {place: (F.lit(1), "count")})
        placed = rows.withColumn(place, F.coalesce(ahead[place], F.lit(0).cast("long")))
    other = placed.select(*keys, (F.col(place) + by).alias(target), F.col(value).alias(found))
    if rotate:
        length = df.agg(F.count(F.lit(1)).alias(n))
        other = other.join(F.broadcast(length), F.lit(True)).select(F.pmod(target, F.col(n)).alias(target), found)
    met_rows = met(placed, other.withColumnRenamed(target, place), [*keys, place], [found], "left")
    return met_rows.withColumn(out, F.col(found)).select(*columns)


def flags(df: DataFrame, key: str, pos: str, segment: str | None = None, head: str = "head", tail: str = "tail", tile: int = TILE) -> DataFrame:
    """``df`` with head (differs from the one before, or has none) and tail (from the one after)."""
    columns = list(dict.fromkeys([*df.columns, head, tail]))
    at, held, a, b = fresh(columns, "tile", "held", "a", "b")
    # The neighbours travel as structs, so that a null key differs from no neighbour at all.
    tiled = df.withColumns({at: tile_of(pos, tile), held: F.struct(F.col(key).alias("k"))})
    both = _neighbour(_neighbour(tiled, at, _keys(segment), held, pos, b), at, _keys(segment), held, pos, a, after=True)
    return both.withColumns({head: ~F.col(held).eqNullSafe(F.col(b)), tail: ~F.col(held).eqNullSafe(F.col(a))}).select(*columns)


def _segment_runs(tiled: DataFrame, tile: str, segment: str, held: str, order: str, out: str) -> DataFrame:
    """Run numbers within segments, in one pass over the rows and one over their tiles: the changes inside each tile, and those between tiles."""
    b, change, first, last, count, ahead = fresh([*tiled.columns, out], "b", "change", "first", "last", "count", "ahead")
    inside = Window.partitionBy(segment, tile).orderBy(order)
    differ = lambda x, y: (~F.col(x).eqNullSafe(F.col(y))).cast("long")
    rows = tiled.withColumn(b, F.lag(held, 1).over(inside)).withColumn(change, F.when(F.col(b).isNull(), 0).otherwise(differ(held, b)))
    numbered = rows.withColumn(out, F.sum(change).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy(segment, tile).agg(F.min_by(held, F.struct(order)).alias(first), F.max_by(held, F.struct(order)).alias(last), F.sum(change).alias(count))
    across = Window.partitionBy(segment).orderBy(tile)
    # The first run of a tile is new if its key differs from the last one before; earlier tiles' changes come on top.
    heads = ends.withColumn(b, F.lag(last, 1).over(across)).withColumn(b, differ(first, b))
    starts = heads.withColumn(ahead, F.sum(F.col(b) + F.col(count)).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(count))
    return met(numbered.drop(b), starts, [segment, tile], [ahead]).withColumn(out, F.col(out) + F.col(ahead))


def run_ids(df: DataFrame, key: str, pos: str, segment: str | None = None, out: str = "run", tile: int = TILE) -> DataFrame:
    """``df`` with the number of each row's run, from 1 (within its segment, if any)."""
    columns = list(dict.fromkeys([*df.columns, out]))
    at, held, b, head, count = fresh(columns, "tile", "held", "b", "head", "count")
    tiled = df.withColumns({at: tile_of(pos, tile), held: F.struct(F.col(key).alias("k"))})
    if segment:
        return _segment_runs(tiled, at, segment, held, pos, out).select(*columns)
    marked = _neighbour(tiled, at, _keys(segment), held, pos, b).withColumn(head, (~F.col(held).eqNullSafe(F.col(b))).cast("long"))
    rows, scanned = scan_tiles(marked, at, _keys(segment), pos, {count: (F.col(head), "sum")}, inclusive=True)
    return rows.withColumn(out, scanned[count]).select(*columns)


def unique(df: DataFrame, key: str, pos: str, segment: str | None = None, tile: int = TILE) -> DataFrame:
    """The first row of each run."""
    at, held, b = fresh(df.columns, "tile", "held", "b")
    tiled = df.withColumns({at: tile_of(pos, tile), held: F.struct(F.col(key).alias("k"))})
    return _neighbour(tiled, at, _keys(segment), held, pos, b).where(~F.col(held).eqNullSafe(F.col(b))).select(*df.columns)


def reduce_by_key(df: DataFrame, key: str, pos: str, aggregates: list[Column], segment: str | None = None, tile: int = TILE) -> DataFrame:
    """One row a run: run, key, offset (first position), length and the aggregates."""
    groups = ["run"] if segment is None else [segment, "run"]
    return run_ids(df, key, pos, segment, tile=tile).groupBy(*groups).agg(F.first(key).alias(key), F.min(pos).alias("offset"), F.count(F.lit(1)).alias("length"), *aggregates)


def run_length_encode(df: DataFrame, key: str, pos: str, segment: str | None = None, tile: int = TILE) -> DataFrame:
    return reduce_by_key(df, key, pos, [], segment, tile)


def nontrivial_runs(df: DataFrame, key: str, pos: str, segment: str | None = None, tile: int = TILE) -> DataFrame:
    """offset and length of the runs of two or more."""
    return run_length_encode(df, key, pos, segment, tile).where("length > 1")


def adjacent_difference(df: DataFrame, value: str, pos: str, out: str = "diff", segment: str | None = None, tile: int = TILE) -> DataFrame:
    """The value less the one before; the first row keeps null."""
    columns = list(dict.fromkeys([*df.columns, out]))
    b, = fresh(columns, "b")
    moved = shift(df, value, pos, 1, b, segment, tile=tile)
    wide = df.schema[value].dataType.typeName() in ("byte", "short", "integer")
    number = (lambda c: F.col(c).cast("long")) if wide else F.col
    return moved.withColumn(out, number(value) - number(b)).select(*columns)


def _flagged_sum(df: DataFrame, value: str, flag: str, pos: str, out: str, inclusive: bool, tile: int) -> DataFrame:
    columns = list(dict.fromkeys([*df.columns, out]))
    at, seg, total = fresh(columns, "tile", "segment", "total")
    tiled = df.withColumn(at, tile_of(pos, tile))
    rows, scanned = scan_tiles(tiled, at, [], pos, {seg: (F.coalesce(F.col(flag).cast("long"), F.lit(0)), "sum")}, inclusive)
    numbered = rows.withColumn(seg, F.coalesce(scanned[seg], F.lit(0).cast("long")))
    # One row for each segment of a tile: a segment that holds all rows is as many rows as it has tiles.
    parts = numbered.groupBy(seg, at).agg(F.sum(F.col(value).cast("long")).alias(total))
    sums = parts.withColumn(total, F.sum(total).over(Window.partitionBy(seg)))
    return met(numbered, sums, [seg, at], [total]).withColumn(out, F.col(total)).select(*columns)


def head_segmented_sum(df: DataFrame, value: str, flag: str, pos: str, out: str = "total", tile: int = TILE) -> DataFrame:
    """Each row's sum over its segment; a segment begins where ``flag`` holds (a null flag does not)."""
    return _flagged_sum(df, value, flag, pos, out, True, tile)


def tail_segmented_sum(df: DataFrame, value: str, flag: str, pos: str, out: str = "total", tile: int = TILE) -> DataFrame:
    """The same where a segment ends at ``flag``."""
    return _flagged_sum(df, value, flag, pos, out, False, tile)
