"""Prefix scans: inclusive and exclusive, for sums and other associative operations, whole or by segment.

``tiled`` (the default) never holds more than a tile of a segment in a task: totals by tile, what
comes before each tile, and a window inside each tile.  ``window`` is Spark's window over the whole
array or segment, which one task holds: simple, and quicker on small inputs.  Both give the same
rows.  Positions are numbers, may have gaps and start anywhere; rows with a null position stand
before all others, in no order among themselves; null values change no result.  The result column
replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridex.operators.tiles import TILE, before, either, fresh, met, tile_of

#: Aggregate of a window or group, how two partial results combine, and the identity (None: null).
OPERATIONS: dict[str, tuple[Callable, Callable, int | None]] = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "min": (F.min, F.least, None),
    "max": (F.max, F.greatest, None),
    "count": (F.count, lambda a, b: a + b, 0),
    "and": (F.bit_and, lambda a, b: a.bitwiseAND(b), -1),
    "or": (F.bit_or, lambda a, b: a.bitwiseOR(b), 0),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def _checked(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")


def _wide(df: DataFrame, value: str, op: str) -> Column:
    kind = df.schema[value].dataType.typeName()
    return F.col(value).cast("long") if kind in ("byte", "short", "integer", "long") or op in ("and", "or", "xor") else F.col(value)


def scan(df: DataFrame, value: str, order: str, out: str = "scan", op: str = "sum", inclusive: bool = False, init: int | None = None, segment: str | None = None, strategy: str = "tiled", tile: int = TILE) -> DataFrame:
    """``df`` with column ``out``: the scan of ``value`` in the order of ``order``, within each ``segment`` if given.

    An exclusive scan starts with ``init`` or the operation's identity; ``init`` also takes part in later results.
    """
    if op not in OPERATIONS:
        raise ValueError(f"unknown operation {op}")
    if strategy not in ("tiled", "window"):
        raise ValueError(f"unknown strategy {strategy}")
    _checked(df, value, order, *([segment] if segment else []))
    aggregate, combine, identity = OPERATIONS[op]
    val, keys = _wide(df, value, op), [segment] if segment else []

    def finished(x: Column) -> Column:
        x = either(x, F.lit(init), combine) if init is not None else x
        return x if identity is None else F.coalesce(x, F.lit(identity))

    if strategy == "window":
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
        return df.withColumn(out, finished(aggregate(val).over(window)))
    at, = fresh([*df.columns, out], "tile")
    found, scanned = scan_tiles(df.withColumn(at, tile_of(order, tile)), at, keys, order, {out: (val, op)}, inclusive)
    return found.withColumn(out, finished(scanned[out])).select(*dict.fromkeys([*df.columns, out]))


def scan_tiles(tiled: DataFrame, tile: str, keys: list[str], order: str, values: dict[str, tuple[Column, str]], inclusive: bool = False) -> tuple[DataFrame, dict[str, Column]]:
    """Rows that hold what the scans of several values need, and the column of each scan; null where nothing came yet."""
    names = dict(zip(values, fresh([*tiled.columns, *values], *[f"total{k}" for k in range(len(values))]), strict=True))
    totals = tiled.groupBy(*keys, tile).agg(*[OPERATIONS[op][0](v).alias(names[o]) for o, (v, op) in values.items()])
    # A count of counts is their sum.
    over = {o: F.sum if op == "count" else OPERATIONS[op][0] for o, (_, op) in values.items()}
    folds = {names[o]: (over[o], lambda c, _, f=over[o]: f(c), OPERATIONS[op][1]) for o, (_, op) in values.items()}
    rows = met(tiled, before(totals, keys, tile, folds), [*keys, tile], list(folds))
    inside = Window.partitionBy(*keys, tile).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    return rows, {o: either(F.col(names[o]), OPERATIONS[op][0](v).over(inside), OPERATIONS[op][1]) for o, (v, op) in values.items()}


def exclusive_sum(df: DataFrame, value: str, order: str, out: str = "scan", **options) -> DataFrame:
    return scan(df, value, order, out, **options)


def inclusive_sum(df: DataFrame, value: str, order: str, out: str = "scan", **options) -> DataFrame:
    return scan(df, value, order, out, inclusive=True, **options)


def local_scan(df: DataFrame, value: str, order: str, tile: int, out: str = "scan", inclusive: bool = False) -> DataFrame:
    """A scan that starts anew every ``tile`` positions; one task holds such a tile."""
    at, = fresh([*df.columns, out], "tile")
    return scan(df.withColumn(at, tile_of(order, tile)), value, order, out, inclusive=inclusive, segment=at, strategy="window").drop(at)


#: Rows folded in a row of a table: a square, as they are folded in lists of ``FOLD_LIST``.
FOLD_LIST, FOLD_LEVELS = 32, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, kind: str, combine: Callable[[Column, Column], Column]) -> Column:
    """The running results of a list.  A list that grows is copied at each step, so only short lists grow: parts, and what comes before each part."""
    step = lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(either(F.try_element_at(done, F.lit(-1)), x, combine))))
    short = lambda part: F.aggregate(part, F.array().cast(f"array<{kind}>"), step)
    parts = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD_LIST).cast("int")), lambda k: short(F.slice(v, k * FOLD_LIST + 1, F.lit(FOLD_LIST))))
    joined = lambda p: let(short(F.transform(p, lambda x: F.try_element_at(x, F.lit(-1)))), lambda ends: F.flatten(F.transform(p, lambda x, k: F.when(k == 0, x).otherwise(F.transform(x, lambda y: either(F.get(ends, k - 1), y, combine))))))
    return let(values, lambda v: let(parts(v), joined))


def fold_scan(df: DataFrame, value: str, order: str, segment: str | None, combine: Callable[[Column, Column], Column], out: str = "scan", inclusive: bool = True, init: Column | None = None) -> DataFrame:
    """segment (if any), order, value, out: the scan by any associative operation, commutative or not, whole or by segment.

    Each level folds up to ``FOLD_LIST`` squared neighbours into one row and hands their total on, so
    work grows with the rows and no row holds a segment.  An exclusive scan gives ``init`` (or null)
    first; null values change nothing; positions are as in ``scan``.
    """
    _checked(df, value, order, *([segment] if segment else []))
    keys, width, kind = ["s"] if segment else [], FOLD_LIST * FOLD_LIST, df.schema[value].dataType.simpleString()
    rows = df.select(*([F.col(segment).alias("s")] if segment else []), F.col(order).alias("p"), F.col(value).alias("v"), tile_of(order, width).alias("t"))

    def listed(rows: DataFrame, by: list[str]) -> DataFrame:
        held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("r"))
        return held.withColumn("f", running(F.col("r.v"), kind, combine))

    levels = [listed(rows, [*keys, "t"])]
    for k in range(FOLD_LEVELS):
        last = k == FOLD_LEVELS - 1
        ends = levels[-1].select(*keys, F.col("t").alias("p"), F.try_element_at("f", F.lit(-1)).alias("v"), *([] if last else [F.floor(F.col("t") / width).alias("t")]))
        levels.append(listed(ends, keys if last else [*keys, "t"]))
    # From the top down: what comes before each entry of a level is what comes before its list and, in it, before the entry.
    ahead = None
    for k in range(FOLD_LEVELS, -1, -1):
        level = levels[k].withColumn("b", F.lit(None).cast(kind)) if ahead is None else met(levels[k], ahead, [*keys, "t"], ["b"])
        each = level.select(*keys, "b", "f", F.posexplode("r").alias("k", "e"))
        earlier = F.when(F.col("k") > 0, either(F.col("b"), F.try_element_at("f", F.col("k")), combine)).otherwise(F.col("b"))
        if k:
            ahead = each.select(*keys, F.col("e.p").alias("t"), earlier.alias("b"))
    result = either(F.col("b"), F.try_element_at("f", F.col("k") + 1), combine) if inclusive else earlier
    if init is not None:
        result = either(init, result, combine)
    return each.select(*([F.col("s").alias(segment)] if segment else []), F.col("e.p").alias(order), F.col("e.v").alias(value), result.alias(out))
