"""Tiles of an ordered array: what lets a scan or a neighbour cross tiles without one task holding all rows.

A tile is a range of positions, so positions may have gaps and start anywhere; rows without a
position stand before all others.  Each tile is summed up in one row, and what comes before a tile
follows from those rows in two levels (tiles within a group of tiles, then groups), so that a task
holds no more than a group of tile rows even where positions are sparse; of a segment one task holds
the tile rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 20
#: Tiles in a group.
GROUP = 1 << 16
NO_POSITION = -(1 << 63)


def fresh(columns: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tile_of(order: str, tile: int) -> Column:
    return F.coalesce(F.floor(F.col(order) / tile), F.lit(NO_POSITION)).cast("long")


def met(left: DataFrame, right: DataFrame, keys: list[str], extra: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the ``extra`` columns of the row of ``right`` that has the same keys, nulls equal."""
    renamed = dict(zip(keys, fresh([*left.columns, *right.columns], *keys), strict=True))
    other = right.select(*[F.col(k).alias(r) for k, r in renamed.items()], *extra)
    condition = None
    for k, r in renamed.items():
        same = F.col(k).eqNullSafe(F.col(r))
        condition = same if condition is None else condition & same
    return left.join(other, condition, how).drop(*renamed.values())


#: The aggregate over a window, the one over a group (given the tile as well), and how a result further away combines with a nearer one.
Fold = tuple[Callable[[Column], Column], Callable[[Column, Column], Column], Callable[[Column, Column], Column]]


def before(totals: DataFrame, segment: list[str], tile: str, folds: dict[str, Fold], backward: bool = False) -> DataFrame:
    """``segment``, ``tile`` and, under the name of each total, what all earlier tiles (later ones, if ``backward``) come to."""
    towards = F.col(tile).desc() if backward else F.col(tile).asc()
    if segment:
        window = Window.partitionBy(*segment).orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*segment, tile, *[over(F.col(c)).over(window).alias(c) for c, (over, _, _) in folds.items()])
    group, *tops = fresh(totals.columns, "group", *[f"top{k}" for k in range(len(folds))])
    grouped = totals.withColumn(group, F.floor(F.col(tile) / GROUP))
    frame = lambda keys, by: Window.partitionBy(*keys).orderBy(F.col(by).desc() if backward else F.col(by).asc()).rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.select(*segment, group, tile, *[over(F.col(c)).over(frame([*segment, group], tile)).alias(c) for c, (over, _, _) in folds.items()])
    sums = grouped.groupBy(*segment, group).agg(*[whole(F.col(c), F.col(tile)).alias(c) for c, (_, whole, _) in folds.items()])
    outer = sums.select(*segment, group, *[over(F.col(c)).over(frame(segment, group)).alias(t) for t, (c, (over, _, _)) in zip(tops, folds.items(), strict=True)])
    joined = met(inner, outer, [*segment, group], tops)
    return joined.select(*segment, tile, *[either(F.col(t), F.col(c), combine).alias(c) for t, (c, (_, _, combine)) in zip(tops, folds.items(), strict=True)])


def either(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The combination of two partial results where a null one stands for nothing yet."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(combine(a, b))
