"""Queries by name over the driver's tables, and the SQL that gives the same rows.

``orders`` serves as an array (o_orderkey is a dense position), ``events`` as runs and segments.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.functions import scalar
from stridex.operators import access, histogram, join, maps, reduce, runs, scan, select, sort, split
from stridex.plans import inspect
from stridex.plans.tables import shared_dir
from stridex.sources import generate
from stridex.sources.tables import save, table, upload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TILE = 1 << 16


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey and the price in whole cents, as sums of doubles depend on their order."""
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type")


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"

# Scans.
for _name, _op, _inclusive in (("scan_exclusive", "sum", False), ("scan_inclusive", "sum", True), ("scan_max", "max", True), ("scan_min", "min", True), ("scan_count", "count", True)):
    _end = "CURRENT ROW" if _inclusive else "1 PRECEDING"
    register(_name, lambda s, d, o=_op, i=_inclusive: scan.scan(orders(s, d), "o_custkey", "o_orderkey", op=o, inclusive=i, tile=TILE).select("o_orderkey", "scan"), f"SELECT o_orderkey, CAST(coalesce({_op}(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND {_end}), 0) AS BIGINT) AS scan FROM orders")
_SUM = ORACLES["scan_exclusive"]
register("scan_window", lambda s, d: scan.exclusive_sum(orders(s, d), "o_custkey", "o_orderkey", strategy="window").select("o_orderkey", "scan"), _SUM)
register("scan_tiled", lambda s, d: scan.exclusive_sum(orders(s, d), "o_custkey", "o_orderkey", tile=1024).select("o_orderkey", "scan"), _SUM)
register("scan_exclusive_min_init", lambda s, d: scan.scan(orders(s, d), "o_custkey", "o_orderkey", op="min", init=100, tile=TILE).select("o_orderkey", "scan"), "SELECT o_orderkey, CAST(least(100, coalesce(min(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100)) AS BIGINT) AS scan FROM orders")
register("scan_local", lambda s, d: scan.local_scan(orders(s, d), "o_custkey", "o_orderkey", 512).select("o_orderkey", "scan"), "SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (PARTITION BY o_orderkey // 512 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM orders")
register("scan_segmented", lambda s, d: scan.inclusive_sum(events(s, d), "event_id", "event_id", segment="user_id").select("event_id", "scan"), "SELECT event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS scan FROM events")
register("scan_fold", lambda s, d: scan.fold_scan(events(s, d).withColumn("v", F.col("event_id")), "v", "event_id", "user_id", lambda a, b: F.greatest(a, b)).select("event_id", "scan"), "SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scan FROM events")

# Maps.
register("map_copy", lambda s, d: maps.copy(orders(s, d), "o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders")
register("map_scale", lambda s, d: maps.scale(orders(s, d), "o_custkey").select("o_orderkey", "out"), "SELECT o_orderkey, o_custkey * 3 AS out FROM orders")
register("map_add", lambda s, d: maps.add(orders(s, d), "o_orderkey", "o_custkey").select("o_orderkey", "out"), "SELECT o_orderkey, o_orderkey + o_custkey AS out FROM orders")
register("map_add_relations", lambda s, d: maps.add_relations(orders(s, d), prices(s, d).withColumnRenamed("cents", "o_custkey"), "o_orderkey", "o_custkey"), f"SELECT o_orderkey, o_custkey + {CENTS} AS out FROM orders")
register("map_triad", lambda s, d: maps.triad(orders(s, d), "o_orderkey", "o_custkey").select("o_orderkey", "out"), "SELECT o_orderkey, o_orderkey + 3 * o_custkey AS out FROM orders")
register("map_increment", lambda s, d: maps.transform(orders(s, d), "o_custkey", scalar.increment).select("o_orderkey", "out"), "SELECT o_orderkey, o_custkey + 1 AS out FROM orders")
register("map_floor_pow2", lambda s, d: maps.transform(orders(s, d), "o_custkey", scalar.floor_power_of_two).select("o_orderkey", "out"), "SELECT o_orderkey, CASE WHEN o_custkey <= 1 THEN 0 ELSE CAST(1 AS BIGINT) << (length(ltrim(bin(o_custkey - 1), '0')) - 1) END AS out FROM orders")
register("map_ceil_pow2", lambda s, d: maps.transform(orders(s, d), "o_custkey", scalar.ceil_power_of_two).select("o_orderkey", "out"), "SELECT o_orderkey, CASE WHEN o_custkey <= 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(ltrim(bin(o_custkey - 1), '0')) END AS out FROM orders")
register("map_heavy", lambda s, d: maps.transform(orders(s, d), "o_custkey", lambda x: scalar.heavy_sum(x, 16)).select("o_orderkey", "out"), "SELECT o_orderkey, CAST(trunc((17 * CAST(o_custkey AS DOUBLE) + 136.0::DOUBLE) * 4 / (0.58::DOUBLE * 16 + 1.33::DOUBLE)) AS INTEGER) AS out FROM orders")
register("map_fma", lambda s, d: maps.transform(orders(s, d), "o_custkey", lambda x: F.round(scalar.repeated_fma(x, 8), 3)).select("o_orderkey", "out"), "SELECT o_orderkey, round(" + "(" * 8 + "CAST(o_custkey AS DOUBLE)" + " * 1.0001::DOUBLE + 1.0001::DOUBLE)" * 8 + ", 3) AS out FROM orders")
register("scalar_bits", lambda s, d: orders(s, d).select("o_orderkey", scalar.bucket(F.col("o_custkey"), 8).alias("low"), scalar.digit(F.col("o_custkey"), 4, 4).alias("digit"), scalar.popcount(F.col("o_custkey")).cast("int").alias("ones"), scalar.exact_log2(F.col("o_custkey")).alias("log2"), scalar.as_text(F.col("o_custkey")).alias("txt")), "SELECT o_orderkey, CAST(o_custkey & 7 AS INTEGER) AS low, (o_custkey >> 4) & 15 AS digit, CAST(bit_count(o_custkey) AS INTEGER) AS ones, CAST(CASE WHEN o_custkey > 0 AND bit_count(o_custkey) = 1 THEN round(log2(o_custkey)) ELSE -1 END AS INTEGER) AS log2, CAST(o_custkey AS VARCHAR) AS txt FROM orders")
register("bandwidth", lambda s, d: orders(s, d).select("o_orderkey", F.round(scalar.gibibytes_per_second(F.col("o_orderkey"), F.lit(8), F.lit(5.0)), 9).alias("rate")), "SELECT o_orderkey, round(o_orderkey * 8 / 1073741824.0::DOUBLE / 5.0::DOUBLE * 1000, 9) AS rate FROM orders")

# Positional access.
_LOC = "(o_orderkey * 7 + 3) % (SELECT count(*) FROM orders)"


def _source(s: SparkSession, d: str) -> DataFrame:
    return orders(s, d).select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("val"))


def _loc(s: SparkSession, d: str) -> DataFrame:
    n = orders(s, d).agg(F.count(F.lit(1)).alias("n"))
    return orders(s, d).join(F.broadcast(n), F.lit(True)).select(F.col("o_orderkey").alias("i"), ((F.col("o_orderkey") * 7 + 3) % F.col("n")).alias("pos"))


register("gather", lambda s, d: access.gather(_source(s, d), _loc(s, d)), f"SELECT a.o_orderkey AS i, b.o_custkey AS val FROM (SELECT o_orderkey, {_LOC} AS p FROM orders) a JOIN orders b ON b.o_orderkey = a.p")
register("gather_out_of_range", lambda s, d: access.gather(_source(s, d), _loc(s, d).withColumn("pos", F.col("pos") + 100), passes=4).select("i", F.coalesce("val", F.lit(-1)).alias("val")), f"SELECT a.o_orderkey AS i, coalesce(b.o_custkey, -1) AS val FROM (SELECT o_orderkey, {_LOC} + 100 AS p FROM orders) a LEFT JOIN orders b ON b.o_orderkey = a.p")
def _passes(s: SparkSession, d: str, passes: int = 4) -> DataFrame:
    """The whole gather as its passes, each over its share of the array."""
    length = table(s, d, "orders").count()
    parts = [access.gather(_source(s, d), _loc(s, d).where(access.in_pass(F.col("pos"), k, passes, length)), missing="drop") for k in range(passes)]
    return functools.reduce(DataFrame.unionByName, parts)


register("gather_pass", _passes, ORACLES["gather"])
register("scatter", lambda s, d: access.scatter(_source(s, d), _loc(s, d)), f"SELECT {_LOC} AS pos, o_custkey AS val FROM orders")
register("scatter_conflict_last", lambda s, d: access.scatter(_source(s, d), _loc(s, d).withColumn("pos", F.floor(F.col("pos") / 4))), f"SELECT p // 4 AS pos, max_by(o_custkey, o_orderkey) AS val FROM (SELECT o_orderkey, o_custkey, {_LOC} AS p FROM orders) GROUP BY 1")

# Split and histograms.
register("histogram_radix", lambda s, d: histogram_radix(s, d), "SELECT CAST(b AS INTEGER) AS bucket, count(o_custkey) AS n FROM range(8) r(b) LEFT JOIN orders ON (o_custkey & 7) = b GROUP BY b")
register("bucket_start", lambda s, d: split.bucket_starts(orders(s, d), "o_custkey", 8), "SELECT CAST(b AS INTEGER) AS bucket, CAST(coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT b, count(o_custkey) AS n FROM range(8) r(b) LEFT JOIN orders ON (o_custkey & 7) = b GROUP BY b)")


def histogram_radix(s: SparkSession, d: str) -> DataFrame:
    return split.histogram(orders(s, d), "o_custkey", 8)


def _split_sql(mask: int, columns: str) -> str:
    return f"SELECT CAST(o_custkey & {mask} AS INTEGER) AS bucket, row_number() OVER (ORDER BY o_custkey & {mask}, o_orderkey) - 1 AS pos, {columns} FROM orders"


register("split_ko", lambda s, d: split.split(orders(s, d), "o_custkey", "o_orderkey", 32, tile=TILE), _split_sql(31, "o_custkey"))
register("split_kv", lambda s, d: split.split(orders(s, d), "o_custkey", "o_orderkey", 32, ["o_orderkey"], tile=TILE), _split_sql(31, "o_custkey, o_orderkey"))
register("split_aos", lambda s, d: split.split(orders(s, d), "o_custkey", "o_orderkey", 32, ["o_orderkey"], layout="aos", tile=TILE).select("bucket", "pos", "t.*"), _split_sql(31, "o_custkey, o_orderkey"))
register("split_wide", lambda s, d: split.split(orders(s, d), "o_custkey", "o_orderkey", 4096, ["o_orderkey"], tile=TILE), _split_sql(4095, "o_custkey, o_orderkey"))
register("multisplit", lambda s, d: split.multisplit(orders(s, d).select("o_orderkey", scalar.bucket(F.col("o_custkey"), 32).alias("k")), "k", "o_orderkey", 32, TILE), _split_sql(31, "CAST(o_custkey & 31 AS INTEGER) AS k"))
register("hist_even", lambda s, d: histogram.histogram_even(prices(s, d), "cents", 0, 50_000_000, 10), f"SELECT CAST(b AS INTEGER) AS bin, count(c) AS n FROM range(10) r(b) LEFT JOIN (SELECT {CENTS} AS c FROM orders) ON c >= b * 5000000 AND c < (b + 1) * 5000000 GROUP BY b")
_LEVELS = [0, 1_000_000, 5_000_000, 10_000_000, 40_000_000]
register("hist_range", lambda s, d: histogram.histogram_range(prices(s, d), "cents", _LEVELS), f"SELECT b AS bin, count(c) AS n FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(zip(_LEVELS, _LEVELS[1:], strict=False)))}) r(b, lo, hi) LEFT JOIN (SELECT {CENTS} AS c FROM orders) ON c >= lo AND c < hi GROUP BY b")
def _extent(s: SparkSession, d: str) -> tuple[int, int]:
    """One more than the greatest customer and order key."""
    return tuple(orders(s, d).agg(F.max("o_custkey") + 1, F.max("o_orderkey") + 1).first())


def _multi_even(s: SparkSession, d: str) -> DataFrame:
    c, o = _extent(s, d)
    bins = {"cust": (histogram.even_bin(F.col("o_custkey"), 0, c, 5), 5), "order": (histogram.even_bin(F.col("o_orderkey"), 0, o, 3), 3)}
    return histogram.multi_histogram(orders(s, d), bins)


def _multi_range(s: SparkSession, d: str) -> DataFrame:
    c, o = _extent(s, d)
    bins = {"cust": (histogram.range_bin(F.col("o_custkey"), [0, c // 3, c]), 2), "order": (histogram.range_bin(F.col("o_orderkey"), [0, o // 7, o // 2, o]), 3)}
    return histogram.multi_histogram(orders(s, d), bins)


def _many_levels(s: SparkSession, d: str) -> DataFrame:
    """Levels that get wider: too many for nested comparisons."""
    return histogram.histogram_range(prices(s, d), "cents", [250 * k * k for k in range(500)])


_BOTH = """
WITH x AS (SELECT max(o_custkey) + 1 AS c, max(o_orderkey) + 1 AS o FROM orders),
v AS (SELECT 'cust' AS channel, o_custkey AS v FROM orders UNION ALL SELECT 'order', o_orderkey FROM orders),
"""
register("hist_multi_even", _multi_even, _BOTH + """
r AS (SELECT 'cust' AS channel, CAST(b AS INTEGER) AS bin, CAST(c AS DOUBLE) / 5 AS w FROM range(5) t(b), x UNION ALL SELECT 'order', CAST(b AS INTEGER), CAST(o AS DOUBLE) / 3 FROM range(3) t(b), x)
SELECT r.channel, bin, count(v) AS n FROM r LEFT JOIN v ON v.channel = r.channel AND CAST(floor(v / w) AS INTEGER) = bin GROUP BY r.channel, bin""")
register("hist_multi_range", _multi_range, _BOTH + """
r AS (SELECT 'cust' AS channel, 0 AS bin, 0 AS lo, c // 3 AS hi FROM x UNION ALL SELECT 'cust', 1, c // 3, c FROM x
  UNION ALL SELECT 'order', 0, 0, o // 7 FROM x UNION ALL SELECT 'order', 1, o // 7, o // 2 FROM x UNION ALL SELECT 'order', 2, o // 2, o FROM x)
SELECT r.channel, bin, count(v) AS n FROM r LEFT JOIN v ON v.channel = r.channel AND v >= lo AND v < hi GROUP BY r.channel, bin""")
register("hist_many_levels", _many_levels, f"SELECT CAST(b AS INTEGER) AS bin, count(c) AS n FROM range(499) r(b) LEFT JOIN (SELECT {CENTS} AS c FROM orders) ON c >= 250 * b * b AND c < 250 * (b + 1) * (b + 1) GROUP BY b")
def _region(s: SparkSession, d: str) -> DataFrame:
    """Orders as an image of 100 columns; the region leaves an eighth of the rows out at either end."""
    c, o = _extent(s, d)
    image, height = orders(s, d).withColumns({"y": F.floor(F.col("o_orderkey") / 100), "x": F.col("o_orderkey") % 100}), -(-o // 100)
    return histogram.histogram_even(histogram.region(image, "y", "x", (height // 8, height - height // 8), (10, 60)), "o_custkey", 0, c, 3)


register("hist_region", _region, """
WITH x AS (SELECT max(o_custkey) + 1 AS c, (max(o_orderkey) + 100) // 100 AS h FROM orders),
v AS (SELECT CAST(floor(o_custkey / (CAST(c AS DOUBLE) / 3)) AS INTEGER) AS bin FROM orders, x
  WHERE o_orderkey // 100 >= h // 8 AND o_orderkey // 100 < h - h // 8 AND o_orderkey % 100 BETWEEN 10 AND 59)
SELECT CAST(b AS INTEGER) AS bin, count(bin) AS n FROM range(3) r(b) LEFT JOIN v ON bin = b GROUP BY b""")

# Sorts.
for _name, _by, _options in (("sort_keys", "o_custkey", {}), ("sort_keys_desc", "o_custkey DESC", {"descending": True}), ("sort_window", "o_custkey", {"strategy": "window"})):
    register(_name, lambda s, d, o=_options: sort.sort(orders(s, d), "o_custkey", "o_orderkey", **o).select("o_custkey", "rank"), f"SELECT o_custkey, CAST(row_number() OVER (ORDER BY {_by}, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
for _name, _by, _down in (("sort_pairs", "o_custkey", False), ("sort_pairs_desc", "o_custkey DESC", True)):
    register(_name, lambda s, d, x=_down: sort.sort(orders(s, d), "o_custkey", "o_orderkey", descending=x).select("o_custkey", "o_orderkey", "rank"), f"SELECT o_custkey, o_orderkey, CAST(row_number() OVER (ORDER BY {_by}, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
register("sort_bits", lambda s, d: sort.sort_bits(orders(s, d), "o_custkey", "o_orderkey", 4, 8).select("o_orderkey", "rank"), "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY (o_custkey >> 4) & 15, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
register("sort_unsigned", lambda s, d: sort.sort_unsigned(orders(s, d).withColumn("k", F.col("o_custkey") - 50), "k", "o_orderkey").select("o_orderkey", "rank"), "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey - 50 < 0, o_custkey, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
for _name, _by, _down in (("seg_sort", "o_orderkey % 97", False), ("seg_sort_desc", "o_orderkey % 97 DESC", True)):
    register(_name, lambda s, d, x=_down: sort.segmented_sort(orders(s, d).withColumn("k", F.col("o_orderkey") % 97), "o_custkey", "k", "o_orderkey", x).select("o_custkey", "o_orderkey", "k", "rank"), f"SELECT o_custkey, o_orderkey, o_orderkey % 97 AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {_by}, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
register("digit_rank", lambda s, d: sort.digit_rank(orders(s, d).withColumn("block", F.floor(F.col("o_orderkey") / 256)), "block", "o_custkey", "o_orderkey", 0, 4).select("o_orderkey", "rank"), "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey // 256 ORDER BY o_custkey & 15, o_orderkey) - 1 AS BIGINT) AS rank FROM orders")
register("top_keys", lambda s, d: sort.top(prices(s, d), "cents", "o_orderkey", 10), f"SELECT o_orderkey, {CENTS} AS cents FROM orders ORDER BY cents DESC, o_orderkey LIMIT 10")

# Joins.
_JOINED = "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


def _joined(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: join.hash_join(orders(s, d).withColumnRenamed("o_orderkey", "l_orderkey"), _lines(s, d), "l_orderkey", strategy).select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey")


for _strategy in ("broadcast", "partitioned", "merge"):
    register(f"join_{_strategy}", _joined(_strategy), _JOINED)
register("join_count", lambda s, d: join.count_matches(orders(s, d).withColumnRenamed("o_orderkey", "l_orderkey"), _lines(s, d), "l_orderkey"), "SELECT count(*) AS matches FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
register("join_count_partitioned", lambda s, d: join.count_matches(orders(s, d), orders(s, d), "o_custkey", "partitioned"), "SELECT count(*) AS matches FROM orders a JOIN orders b USING (o_custkey)")
register("join_nested_loop", lambda s, d: join.nested_loop_join(table(s, d, "nation"), table(s, d, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
register("join_indexed", lambda s, d: join.indexed_join(_lines(s, d), "l_partkey", table(s, d, "part").select(F.col("p_partkey").alias("pos"), "p_size")).select("l_orderkey", "l_linenumber", "p_size"), "SELECT l_orderkey, l_linenumber, p_size FROM lineitem JOIN part ON l_partkey = p_partkey")
def _bands(s: SparkSession, d: str) -> DataFrame:
    count = -(-_extent(s, d)[0] // 70)
    return join.band_join(orders(s, d), s.range(count).select((F.col("id") * 70).alias("low"), (F.col("id") * 70 + 90).alias("high")), "o_custkey", "low", "high", 64).select("o_orderkey", "low")


register("join_band", _bands, "SELECT o_orderkey, r.b * 70 AS low FROM orders JOIN (SELECT unnest(range((SELECT (max(o_custkey) + 70) // 70 FROM orders))) AS b) r ON o_custkey >= r.b * 70 AND o_custkey < r.b * 70 + 90")
register("join_semi", lambda s, d: join.hash_join(orders(s, d).select(F.col("o_custkey").alias("c_custkey")), table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", how="left_semi"), "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
register("join_anti", lambda s, d: join.hash_join(orders(s, d).where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("c_custkey")), table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", how="left_anti"), "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)")

# Reductions.
register("reduce_all", lambda s, d: reduce.reduce(prices(s, d), "cents"), f"SELECT CAST(sum(c) AS BIGINT) AS sum, min(c) AS min, max(c) AS max, count(c) AS n FROM (SELECT {CENTS} AS c FROM orders)")
register("reduce_any", lambda s, d: reduce.reduce_by(orders(s, d), "o_custkey", lambda a, b: a.bitwiseXOR(b), F.lit(0).cast("long")), "SELECT bit_xor(o_custkey) AS result FROM orders")
register("argmin", lambda s, d: reduce.argmin(prices(s, d), "cents", "o_orderkey"), f"SELECT o_orderkey AS key, {CENTS} AS value FROM orders ORDER BY value, key LIMIT 1")
register("argmax", lambda s, d: reduce.argmax(prices(s, d), "cents", "o_orderkey"), f"SELECT o_orderkey AS key, {CENTS} AS value FROM orders ORDER BY value DESC, key LIMIT 1")
_SEG = "SELECT c_custkey, {} FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, {} AS v FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey"


def _by_customer(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))


register("seg_reduce", lambda s, d: reduce.segmented_reduce(_by_customer(s, d), table(s, d, "customer"), "c_custkey", "v"), _SEG.format("CAST(coalesce(sum(v), 0) AS BIGINT) AS sum, coalesce(min(v), 2147483647) AS min, coalesce(max(v), -2147483648) AS max, count(v) AS n", CENTS))
for _name, _small, _empty in (("seg_argmin", True, 2147483647), ("seg_argmax", False, -2147483648)):
    register(_name, lambda s, d, x=_small: reduce.segmented_arg(_by_customer(s, d), table(s, d, "customer"), "c_custkey", "v", "o_orderkey", x), f"SELECT c_custkey, coalesce(b[1], 1) AS key, coalesce(b[2], {_empty}) AS value FROM (SELECT c_custkey, (list([o_orderkey, v] ORDER BY v {'ASC' if _small else 'DESC'}, o_orderkey) FILTER (v IS NOT NULL))[1] AS b FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, {CENTS} AS v FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey)")
register("tile_sums", lambda s, d: reduce.tile_sums(orders(s, d), "o_custkey", "o_orderkey", 512), "SELECT o_orderkey // 512 AS tile, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders GROUP BY 1")
register("strided_odd_count", lambda s, d: reduce.odd_counts(orders(s, d), "o_custkey", "o_orderkey", 256), "SELECT o_orderkey // 256 AS tile, CAST(sum(o_custkey & 1) AS BIGINT) AS odd FROM orders GROUP BY 1")
register("spmv", lambda s, d: reduce.spmv(table(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("val")), table(s, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").cast("long").alias("x"))), "SELECT l_orderkey AS row, CAST(sum(CAST(trunc(l_quantity) AS BIGINT) * p_size) AS BIGINT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
register("hampel_mean", lambda s, d: reduce.hampel_mean(prices(s, d), "cents").select(F.round("mean", 2).alias("mean")), f"WITH v AS (SELECT CAST({CENTS} AS DOUBLE) AS x FROM orders), a AS (SELECT x, abs(x - (SELECT median(x) FROM v)) AS d FROM v), m AS (SELECT median(d) AS mad FROM a) SELECT round(avg(x), 2) AS mean FROM a, m WHERE CASE WHEN mad = 0 THEN d = 0 ELSE d * 0.6745 / mad <= 3.5 END")

# Runs and neighbours.
_RUN = "WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, CAST(sum(h) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM f) "
_ALL = _RUN.replace("PARTITION BY user_id ", "")
register("rle", lambda s, d: runs.run_length_encode(events(s, d), "event_type", "event_id", "user_id").select("user_id", "run", "event_type", "length"), _RUN + "SELECT user_id, run, any_value(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run")
register("rle_global", lambda s, d: runs.run_length_encode(events(s, d), "event_type", "event_id").select("run", "event_type", "offset", "length"), _ALL + "SELECT run, any_value(event_type) AS event_type, min(event_id) AS \"offset\", count(*) AS length FROM r GROUP BY run")
register("nontrivial_runs", lambda s, d: runs.nontrivial_runs(events(s, d), "event_type", "event_id").select("offset", "length"), _ALL + "SELECT min(event_id) AS \"offset\", count(*) AS length FROM r GROUP BY run HAVING count(*) > 1")
register("reduce_by_key", lambda s, d: runs.reduce_by_key(events(s, d), "event_type", "event_id", [F.sum("user_id").alias("total")], "user_id").select("user_id", "run", "total"), _RUN + "SELECT user_id, run, CAST(sum(user_id) AS BIGINT) AS total FROM r GROUP BY user_id, run")
register("unique_runs", lambda s, d: runs.unique(events(s, d), "event_type", "event_id"), _ALL + "SELECT event_id, user_id, event_type FROM r WHERE h = 1")
register("head_tail_flags", lambda s, d: runs.flags(events(s, d), "event_type", "event_id", "user_id").select("event_id", "head", "tail"), "SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS head, event_type IS DISTINCT FROM lead(event_type) OVER w OR lead(event_id) OVER w IS NULL AS tail FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
register("adjacent_diff", lambda s, d: runs.adjacent_difference(orders(s, d), "o_custkey", "o_orderkey").select("o_orderkey", F.coalesce("diff", F.lit(0)).alias("diff")), "SELECT o_orderkey, coalesce(o_custkey - lag(o_custkey) OVER (ORDER BY o_orderkey), 0) AS diff FROM orders")
register("shift_up", lambda s, d: runs.shift(orders(s, d), "o_custkey", "o_orderkey", 3, "moved").select("o_orderkey", F.coalesce("moved", F.lit(-1)).alias("moved")), "SELECT o_orderkey, coalesce(lag(o_custkey, 3) OVER (ORDER BY o_orderkey), -1) AS moved FROM orders")
register("shift_down", lambda s, d: runs.shift(orders(s, d), "o_custkey", "o_orderkey", -2, "moved").select("o_orderkey", F.coalesce("moved", F.lit(-1)).alias("moved")), "SELECT o_orderkey, coalesce(lead(o_custkey, 2) OVER (ORDER BY o_orderkey), -1) AS moved FROM orders")
register("rotate", lambda s, d: runs.shift(orders(s, d), "o_custkey", "o_orderkey", 5, "moved", rotate=True).select("o_orderkey", "moved"), "SELECT (o_orderkey + 5) % (SELECT count(*) FROM orders) AS o_orderkey, o_custkey AS moved FROM orders")
_HEADS = "SELECT event_id, CAST(sum(user_id) OVER (PARTITION BY g) AS BIGINT) AS total FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {}) AS g FROM events)"
_flagged = lambda s, d: events(s, d).withColumn("f", F.col("event_type") == "purchase")
register("head_segmented_sum", lambda s, d: runs.head_segmented_sum(_flagged(s, d), "user_id", "f", "event_id").select("event_id", "total"), _HEADS.format("CURRENT ROW"))
register("tail_segmented_sum", lambda s, d: runs.tail_segmented_sum(_flagged(s, d), "user_id", "f", "event_id").select("event_id", "total"), _HEADS.format("1 PRECEDING").replace("SELECT *, sum(", "SELECT *, coalesce(sum(").replace(") AS g", "), 0) AS g"))

# Selection.
_EVEN = "o_custkey % 3 = 0"
register("select_if", lambda s, d: select.select_if(orders(s, d), F.expr(_EVEN), "o_orderkey", tile=TILE), f"SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS out_pos FROM orders WHERE {_EVEN}")
register("select_flagged", lambda s, d: select.select_flagged(orders(s, d), orders(s, d).select("o_orderkey", F.expr(_EVEN).alias("flag")), "o_orderkey"), ORACLES["select_if"])
_HALVES = f"SELECT o_orderkey, o_custkey, {_EVEN} AS selected, CASE WHEN {_EVEN} THEN s - 1 ELSE n - 1 - (o_orderkey - s) END AS out_pos FROM (SELECT *, CAST(sum(CASE WHEN {_EVEN} THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER () AS n FROM orders)"
register("partition_if", lambda s, d: select.partition_if(orders(s, d), F.expr(_EVEN), "o_orderkey", tile=TILE), _HALVES)
register("partition_flagged", lambda s, d: select.partition_flagged(orders(s, d), orders(s, d).select("o_orderkey", F.expr(_EVEN).alias("flag")), "o_orderkey"), _HALVES)
def _middle(s: SparkSession, d: str) -> DataFrame:
    n = _extent(s, d)[1]
    return orders(s, d).where(select.in_range(F.col("o_orderkey"), n // 10, n - n // 10))


register("select_range", _middle, "SELECT o_orderkey, o_custkey FROM orders, (SELECT max(o_orderkey) + 1 AS n FROM orders) WHERE o_orderkey >= n // 10 AND o_orderkey < n - n // 10")

# Positions with gaps, with an offset or null, and results that start from a value.
_ODD = "(SELECT event_id, user_id, event_type FROM events WHERE event_id % 2 = 1 AND event_id % 7 <> 3)"
_odd = lambda s, d: events(s, d).where("event_id % 2 = 1 AND event_id % 7 <> 3")
_GAPS = _ALL.replace("FROM events WINDOW", f"FROM {_ODD} WINDOW")
register("rle_gaps", lambda s, d: runs.run_length_encode(_odd(s, d), "event_type", "event_id", tile=64), _GAPS + "SELECT run, any_value(event_type) AS event_type, min(event_id) AS \"offset\", count(*) AS length FROM r GROUP BY run")
register("unique_gaps", lambda s, d: runs.unique(_odd(s, d), "event_type", "event_id", tile=64), _GAPS + "SELECT event_id, user_id, event_type FROM r WHERE h = 1")
register("adjacent_diff_gaps", lambda s, d: runs.adjacent_difference(_odd(s, d), "user_id", "event_id", tile=64).select("event_id", F.coalesce("diff", F.lit(0)).alias("diff")), f"SELECT event_id, coalesce(user_id - lag(user_id) OVER (ORDER BY event_id), 0) AS diff FROM {_ODD}")
register("shift_gaps", lambda s, d: runs.shift(_odd(s, d), "user_id", "event_id", 4, "moved", tile=64).select("event_id", F.coalesce("moved", F.lit(-1)).alias("moved")), f"SELECT event_id, coalesce(lag(user_id, 4) OVER (ORDER BY event_id), -1) AS moved FROM {_ODD}")
register("scan_null_pos", lambda s, d: scan.inclusive_sum(orders(s, d).withColumn("p", F.when(F.col("o_orderkey") != 5, F.col("o_orderkey"))), "o_custkey", "p", tile=64).select("o_orderkey", "scan"), "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY CASE WHEN o_orderkey <> 5 THEN o_orderkey END NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS scan FROM orders")
register("scan_segmented_tiled", lambda s, d: scan.exclusive_sum(orders(s, d).withColumn("g", F.col("o_orderkey") % 3 == 0), "o_custkey", "o_orderkey", segment="g", tile=256).select("o_orderkey", "scan"), "SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (PARTITION BY o_orderkey % 3 = 0 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM orders")
register("partition_offset", lambda s, d: select.partition_if(orders(s, d).withColumn("o_orderkey", F.col("o_orderkey") * 3 + 1000), F.col("o_custkey") % 3 == 0, "o_orderkey", tile=TILE), "SELECT o_orderkey * 3 + 1000 AS o_orderkey, o_custkey, o_custkey % 3 = 0 AS selected, CASE WHEN o_custkey % 3 = 0 THEN s - 1 ELSE n - 1 - (i - s) END AS out_pos FROM (SELECT *, CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
register("reduce_init", lambda s, d: reduce.reduce_by(orders(s, d), "o_custkey", lambda a, b: a + b, F.lit(5).cast("long")), "SELECT CAST(sum(o_custkey) + 5 AS BIGINT) AS result FROM orders")
# The right value if it is a multiple of five, else the left one: associative, and not commutative.
_right = lambda a, b: F.when(b % 5 == 0, b).otherwise(a)
_FOLD = "coalesce(last_value(CASE WHEN o_custkey % 5 = 0 THEN o_custkey END IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND {}), {})"
register("scan_fold_all", lambda s, d: scan.fold_scan(orders(s, d), "o_custkey", "o_orderkey", None, _right).select("o_orderkey", "scan"), "SELECT o_orderkey, " + _FOLD.format("CURRENT ROW", "first_value(o_custkey) OVER (ORDER BY o_orderkey)") + " AS scan FROM orders")
register("scan_fold_exclusive", lambda s, d: scan.fold_scan(orders(s, d), "o_custkey", "o_orderkey", None, _right, inclusive=False, init=F.lit(-7).cast("long")).select("o_orderkey", "scan"), "SELECT o_orderkey, CAST(" + _FOLD.format("1 PRECEDING", "-7") + " AS BIGINT) AS scan FROM orders")
register("spmv_empty_rows", lambda s, d: reduce.spmv(table(s, d, "lineitem").where("l_orderkey % 4 = 1").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("long").alias("val")), table(s, d, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").cast("long").alias("x")), orders(s, d).select(F.col("o_orderkey").alias("row"))), "SELECT o_orderkey AS row, CAST(coalesce(sum(CAST(trunc(l_quantity) AS BIGINT) * p_size), 0) AS BIGINT) AS y FROM orders LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 4 = 1) ON l_orderkey = o_orderkey GROUP BY o_orderkey")

# Generated inputs.
register("generate_permutation", lambda s, d: generate.permutation(s, 10_000), "SELECT i, (i * 7 + 3) % 10000 AS pos FROM range(10000) r(i)")
register("generate_counting", lambda s, d: generate.counting(s, 10_000, 10), "SELECT i AS pos, i + 10 AS val FROM range(10000) r(i)")
register("generate_constant", lambda s, d: generate.constant(s, 10_000, 1024), "SELECT i AS pos, 1024 AS val FROM range(10000) r(i)")
register("generate_uniform", lambda s, d: generate.uniform(s, 10_000, 64).select("pos", F.col("val").between(0, 63).alias("in_range")), "SELECT i AS pos, true AS in_range FROM range(10000) r(i)")

# Rows of the driver, written files and the code of a plan.
register("upload", lambda s, d: upload(s, [(k, f"row {k}", k * 0.5) for k in range(100)], "id long, name string, half double"), "SELECT i AS id, 'row ' || i AS name, i * 0.5::DOUBLE AS half FROM range(100) r(i)")


def _reread(file_format: str, schema: str | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        path = f"{shared_dir(s)}/saved-{file_format}"
        save(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, file_format)
        reader = s.read.format(file_format)
        return (reader.schema(schema) if schema else reader).load(path)

    return query


for _format in ("parquet", "orc", "json", "csv"):
    register(f"save_{_format}", _reread(_format, None if _format in ("parquet", "orc") else "n_nationkey long, n_name string, n_regionkey long"), "SELECT n_nationkey, n_name, n_regionkey FROM nation")
register("generated_code", lambda s, d: upload(s, [("class" in inspect.generated_code(orders(s, d).where("o_custkey > 3")),)], "has_class boolean"), "SELECT true AS has_class")
