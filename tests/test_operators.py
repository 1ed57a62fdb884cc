"""Worked examples, and the cases that are easily missed: empty input, one row, tile edges, nulls, duplicates."""

import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from stridex.functions import scalar
from stridex.operators import access, histogram, join, maps, reduce, runs, scan, select, sort, split
from stridex.plans import inspect
from stridex.sources import generate

rng = random.Random(41)
A = [rng.randrange(40) for _ in range(11)]
K = [rng.randrange(3) for _ in range(17)]
BIG = 2**31 - 1


@pytest.fixture(scope="module")
def array(spark):
    def make(values, name="val"):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos long, {name} long")

    return make


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def by_rank(got, name):
    return [r[name] for r in got.orderBy("rank").collect()]


def brute_runs(keys):
    """(key, first index, length) of each run."""
    at, out = 0, []
    for k, some in itertools.groupby(keys):
        n = len(list(some))
        out.append((k, at, n))
        at += n
    return out


@pytest.mark.parametrize("options", [{"strategy": "window"}, {"tile": 2}, {"tile": 3}, {"tile": 100}])
def test_scan_examples(array, options):
    df, running = array(A), lambda f: list(itertools.accumulate(A, f))
    assert column(scan.exclusive_sum(df, "val", "pos", **options), "scan") == [0, *running(operator.add)[:-1]]
    assert column(scan.inclusive_sum(df, "val", "pos", **options), "scan") == running(operator.add)
    assert column(scan.scan(df, "val", "pos", op="min", init=BIG, **options), "scan") == [BIG, *running(min)[:-1]]
    assert column(scan.scan(df, "val", "pos", op="min", inclusive=True, **options), "scan") == running(min)
    assert column(scan.scan(df, "val", "pos", op="xor", inclusive=True, **options), "scan") == running(operator.xor)


@pytest.mark.parametrize("options", [{"strategy": "window"}, {"tile": 4}, {"tile": 1000}])
def test_scan_gaps_nulls_and_names(spark, options):
    """Positions with gaps, below zero and null; columns of the names that operators use inside."""
    rows = [(p, v, v % 2, 1, 2) for p, v in zip([-40, -3, 0, 1, 9, 500, 10**15], A, strict=False)]
    df = spark.createDataFrame([*rows, (None, 1000, 0, 1, 2)], "pos long, val long, seg int, __tile int, __total0 int")
    for segment in (None, "seg"):
        got = scan.scan(df, "val", "pos", inclusive=True, segment=segment, **options)
        assert got.columns == [*df.columns, "scan"]
        sums = {0: 1000, 1: 0} if segment else {0: 1000}
        for r in got.where("pos IS NOT NULL").orderBy("pos").collect():
            key = r.seg if segment else 0
            sums[key] += r.val
            assert r.scan == sums[key] and (r["__tile"], r["__total0"]) == (1, 2)
        assert got.where("pos IS NULL").first().scan == 1000


def test_scan_of_one_hot_segment(spark):
    df = spark.range(300).selectExpr("id AS pos", "id % 7 AS val", "int(id < 10) AS seg")
    got = {r.pos: r.scan for r in scan.exclusive_sum(df, "val", "pos", segment="seg", tile=16).collect()}
    assert all(got[p] == sum(k % 7 for k in range(0 if p < 10 else 10, p)) for p in got) and len(got) == 300


def test_scan_edges(spark, array):
    assert scan.exclusive_sum(array([]), "val", "pos").collect() == []
    assert column(scan.exclusive_sum(array([5]), "val", "pos"), "scan") == [0]
    assert column(scan.inclusive_sum(array([None, 3, None, 4]), "val", "pos", tile=2), "scan") == [0, 3, 3, 7]
    big = spark.createDataFrame([(0, 2**31 - 1), (1, 2**31 - 1)], "pos long, val int")
    assert column(scan.inclusive_sum(big, "val", "pos"), "scan")[-1] == 2**32 - 2
    with pytest.raises(ValueError):
        scan.scan(array(A), "val", "pos", op="avg")
    with pytest.raises(ValueError):
        scan.scan(array(A), "none", "pos")


def test_tiled_scan_keeps_rows_apart(array):
    # The only single partition holds one row a group of tiles; the rows themselves meet by tile.
    plan = inspect.physical_plan(scan.exclusive_sum(array(A), "val", "pos", tile=2))
    assert "hashpartitioning(__tile" in plan


def test_fold_scan_is_ordered(spark, array):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z"), (None, 4, "n")], "seg int, pos long, val string")
    got = scan.fold_scan(df, "val", "pos", "seg", lambda a, b: F.concat(a, b))
    assert column(got.where("seg = 1"), "scan") == ["a", "ab", "abc"] and column(got.where("seg IS NULL"), "scan") == ["n"]
    assert scan.fold_scan(array([]), "val", "pos", None, lambda a, b: a + b).collect() == []


@pytest.mark.parametrize("width", [2, 32])
def test_fold_scan_over_a_whole_array(spark, monkeypatch, width):
    """A product of 2 x 2 matrices modulo a prime does not commute; several levels are met with short lists."""
    monkeypatch.setattr(scan, "FOLD_LIST", width)
    cells = [(p, [rng.randrange(9) for _ in range(4)]) for p in (*range(-5, 60), *range(1000, 1040, 3))]
    df = spark.createDataFrame(cells, "pos long, val array<long>")
    times = lambda a, b: F.array(*[(a[i] * b[j] + a[i + 1] * b[j + 2]) % 97 for i in (0, 2) for j in (0, 1)])
    plain = lambda a, b: [(a[i] * b[j] + a[i + 1] * b[j + 2]) % 97 for i in (0, 2) for j in (0, 1)]
    expected = list(itertools.accumulate((v for _, v in cells), plain))
    one = F.array(*[F.lit(x).cast("long") for x in (1, 0, 0, 1)])
    assert column(scan.fold_scan(df, "val", "pos", None, times), "scan") == expected
    assert column(scan.fold_scan(df, "val", "pos", None, times, inclusive=False, init=one), "scan") == [[1, 0, 0, 1], *[plain([1, 0, 0, 1], e) for e in expected[:-1]]]


@pytest.mark.parametrize("tile", [1, 3, 100])
def test_split_is_stable_and_complete(array, tile):
    keys = [5, -3, 8, 8, 5, 0, 13, -1, 5]
    got = split.split(array(keys, "key").withColumn("v", F.col("pos") * 10), "key", "pos", 8, ["v"], tile=tile).orderBy("pos").collect()
    expected = sorted(((k & 7, i, k) for i, k in enumerate(keys)))
    assert [(r.bucket, r.pos, r.key, r.v) for r in got] == [(b, n, k, i * 10) for n, (b, i, k) in enumerate(expected)]


def test_split_layouts_and_checks(array):
    df = array([3, 1, 2], "key").withColumn("v", F.lit(7))
    packed = split.split(df, "key", "pos", 4, ["v"], layout="aos")
    assert [r.t.key for r in packed.orderBy("pos").collect()] == [1, 2, 3]
    assert [r.n for r in split.histogram(array([3, 3], "key"), "key", 4).orderBy("bucket").collect()] == [0, 0, 0, 2]
    assert [r.start for r in split.bucket_starts(array([0, 3, 3, 1], "key"), "key", 4).orderBy("bucket").collect()] == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        split.split(df, "key", "pos", 6)
    with pytest.raises(Exception, match="bucket out of range"):
        split.multisplit(array([9], "key"), "key", "pos", 4).collect()


def test_gather_scatter(spark, array):
    source = array([10, 11, 12])
    loc = spark.createDataFrame([(0, 2), (1, 0), (2, 7)], "i long, pos long")
    assert column(access.gather(source, loc, passes=8), "val", "i") == [12, 10, None]
    assert column(access.gather(source, loc, missing="drop"), "val", "i") == [12, 10]
    twice = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "i long, pos long")
    assert column(access.scatter(source, twice), "val") == [12, 11]
    assert column(access.scatter(source, twice, on_conflict="first"), "val") == [12, 10]
    with pytest.raises(Exception, match="one target"):
        access.scatter(source, twice, on_conflict="error").collect()


def test_permutation_round_trip(spark):
    loc = generate.permutation(spark, 1000)
    assert loc.select("pos").distinct().count() == 1000
    source = generate.uniform(spark, 1000, 16)
    back = access.gather(access.scatter(source, loc), loc)
    assert back.selectExpr("i AS pos", "val AS got").join(source, "pos").where("got <> val").count() == 0


@pytest.mark.parametrize("strategy", ["range", "window"])
def test_sorts(array, strategy):
    df = array(A)
    places = sorted(range(len(A)), key=lambda i: (A[i], i))
    up, down = sort.sort(df, "val", "pos", strategy=strategy), sort.sort(df, "val", "pos", descending=True, strategy=strategy)
    assert by_rank(up, "val") == sorted(A) and by_rank(up, "pos") == places
    assert by_rank(down, "pos") == sorted(range(len(A)), key=lambda i: (-A[i], i))
    assert up.schema["rank"].dataType.simpleString() == "bigint" and up.columns == ["pos", "val", "rank"]
    signs = array([-1, 3, -2, 0])
    assert by_rank(sort.sort(signs, "val", "pos", strategy=strategy), "val") == [-2, -1, 0, 3]
    assert by_rank(sort.sort_unsigned(signs, "val", "pos", strategy=strategy), "val") == [0, 3, -2, -1]
    assert by_rank(sort.sort_bits(array([16, 1, 32]), "val", "pos", 4, 8, strategy=strategy), "val") == [1, 16, 32]
    assert sort.sort(array([]), "val", "pos", strategy=strategy).collect() == []


@pytest.mark.parametrize("strategy", ["range", "window"])
def test_segmented_sorts(spark, strategy):
    """One segment holds most rows; a null segment is a segment."""
    rows = [(0 if i % 5 else (None if i % 2 else 3), i, rng.randrange(20)) for i in range(120)]
    df = spark.createDataFrame(rows, "seg long, pos long, val long")
    for descending in (False, True):
        got = {r.pos: r["rank"] for r in sort.segmented_sort(df, "seg", "val", "pos", descending, strategy=strategy).collect()}
        for seg in (0, 3, None):
            mine = sorted((r for r in rows if r[0] == seg), key=lambda r: (-r[2] if descending else r[2], r[1]))
            assert [got[r[1]] for r in mine] == list(range(len(mine)))


def test_segmented_reductions(spark):
    cells = {0: A[:4], 1: [], 2: A[4:]}
    df = spark.createDataFrame([(s, k, v) for s, vs in cells.items() for k, v in enumerate(vs)], "seg long, off long, val long")
    segments = spark.createDataFrame([(s,) for s in cells], "seg long")
    got = reduce.segmented_reduce(df, segments, "seg", "val").orderBy("seg").collect()
    assert [r["sum"] for r in got] == [sum(v) for v in cells.values()]
    assert [r["min"] for r in got] == [min(v, default=BIG) for v in cells.values()]
    assert [r["max"] for r in got] == [max(v, default=-BIG - 1) for v in cells.values()]
    low = reduce.segmented_arg(df, segments, "seg", "val", "off").orderBy("seg").collect()
    high = reduce.segmented_arg(df, segments, "seg", "val", "off", smallest=False).orderBy("seg").collect()
    assert [(r["key"], r["value"]) for r in low] == [(v.index(min(v)), min(v)) if v else (1, BIG) for v in cells.values()]
    assert [(r["key"], r["value"]) for r in high] == [(v.index(max(v)), max(v)) if v else (1, -BIG - 1) for v in cells.values()]


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "partitioned", "merge"])
def test_joins_keep_duplicates(spark, strategy):
    build = spark.createDataFrame([(1, "a"), (1, "b"), (-1, "c"), (None, "d")], "k int, r string")
    probe = spark.createDataFrame([(1, 10), (1, 11), (-1, 12), (None, 13), (5, 14)], "k int, s int")
    assert join.hash_join(build, probe, "k", strategy).count() == 5
    assert join.count_matches(build, probe, "k", strategy).first()["matches"] == 5
    assert join.count_matches(build.limit(0), probe, "k", strategy).first()["matches"] == 0


def test_join_strategies_show_in_the_plan(spark):
    a, b = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).withColumnRenamed("id", "k")
    for strategy, name in (("broadcast", "BroadcastHashJoin"), ("partitioned", "ShuffledHashJoin"), ("merge", "SortMergeJoin")):
        assert name in inspect.physical_plan(join.hash_join(b, a, "k", strategy))
    assert "ShuffledHashJoin" in inspect.physical_plan(join.hash_join(b, a, "k", "broadcast", broadcast_bytes=10))
    assert "BroadcastNestedLoopJoin" in inspect.physical_plan(join.nested_loop_join(a, b, a.k < b.k))
    assert join.nested_loop_join(a, b, a.k < b.k, broadcast_bytes=10).count() == sum(min(k, 100) for k in range(50))


def test_broadcast_goes_by_rows_in_memory(spark, tmp_path):
    """Files that are far smaller than their rows: the plan's estimate is within the bound, the rows are not."""
    path = str(tmp_path / "t")
    spark.range(200_000).select((F.col("id") % 7).alias("k"), F.lit("x" * 50).alias("s")).coalesce(1).write.parquet(path)
    build, probe = spark.read.parquet(path), spark.range(7).withColumnRenamed("id", "k")
    bound = 8 << 20
    assert join.estimated_bytes(build) < bound
    for some in (build, build.select("k")):
        met = join.hash_join(some, probe, "k", "broadcast", broadcast_bytes=bound)
        assert "ShuffledHashJoin" in inspect.physical_plan(met) and met.count() == 200_000
    assert "BroadcastHashJoin" in inspect.physical_plan(join.hash_join(build.limit(100), probe, "k", "broadcast", broadcast_bytes=bound))
    assert not join.fits(build.select(F.array("k").alias("k")), bound) and join.fits(build.limit(0), 10)


def test_band_join_equals_nested_loop(spark):
    left = spark.range(50).withColumnRenamed("id", "x")
    right = spark.createDataFrame([(0, 3), (2, 30), (29, 31)], "low long, high long")
    fast = join.band_join(left, right, "x", "low", "high", 7).select("x", "low")
    slow = join.nested_loop_join(left, right, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("x", "low")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_reductions(array):
    df = array(A)
    assert reduce.reduce(df, "val").first().asDict() == {"sum": sum(A), "min": min(A), "max": max(A), "n": len(A)}
    assert tuple(reduce.argmin(df, "val", "pos").first()) == (A.index(min(A)), min(A))
    assert tuple(reduce.argmax(df, "val", "pos").first()) == (A.index(max(A)), max(A))
    assert tuple(reduce.argmin(array([4, 4]), "val", "pos").first()) == (0, 4) and tuple(reduce.argmax(array([4, 4]), "val", "pos").first()) == (0, 4)
    assert tuple(reduce.argmin(array([]), "val", "pos").first()) == (None, None)
    assert reduce.hampel_mean(array([10, 11, 9, 10, 500]), "val").first()["mean"] == 10
    assert reduce.hampel_mean(array([7, 7, 7, 900]), "val").first()["mean"] == 7


def test_reduce_by_counts_init_once(spark, array):
    add = lambda a, b: a + b
    hundred = spark.range(1, 101).repartition(7)
    assert reduce.reduce_by(hundred, "id", add, F.lit(5).cast("long")).first()["result"] == 5055
    assert reduce.reduce_by(hundred, "id", add).first()["result"] == 5050
    assert reduce.reduce_by(spark.range(30_000).selectExpr("id * 0 + 2 AS id"), "id", add).first()["result"] == 60_000
    assert reduce.reduce_by(array([None, 3, None]), "val", add).first()["result"] == 3
    assert reduce.reduce_by(array([]), "val", add, F.lit(5).cast("long")).first()["result"] == 5
    assert reduce.reduce_by(array([]), "val", add).first()["result"] is None


@pytest.mark.parametrize(("tile", "step"), [(1, 4), (3, 1), (1 << 20, 4)])
def test_runs(spark, tile, step):
    """Positions are ``step`` apart and begin below zero; every neighbour may lie in another tile."""
    keys = [None, None, *K]
    df = spark.createDataFrame([(step * i - 7, k, i * i, -1, -2) for i, k in enumerate(keys)], "pos long, key long, v long, __tile int, head_ int")
    expected = brute_runs(keys)
    encoded = runs.reduce_by_key(df, "key", "pos", [F.max("v").alias("m")], tile=tile).orderBy("run").collect()
    assert [(r.run, r["key"], r["offset"], r["length"], r.m) for r in encoded] == [(n, k, step * at - 7, size, (at + size - 1) ** 2) for n, (k, at, size) in enumerate(expected, 1)]
    assert [(r["offset"], r["length"]) for r in runs.nontrivial_runs(df, "key", "pos", tile=tile).orderBy("offset").collect()] == [(step * at - 7, size) for _, at, size in expected if size > 1]
    kept = runs.unique(df, "key", "pos", tile=tile)
    assert kept.columns == df.columns and column(kept, "pos") == [step * at - 7 for _, at, _ in expected]
    flags = runs.flags(df, "key", "pos", tile=tile).orderBy("pos").collect()
    assert [i for i, r in enumerate(flags) if r.head] == [at for _, at, _ in expected]
    assert [i for i, r in enumerate(flags) if r.tail] == [at + size - 1 for _, at, size in expected]
    squares = [i * i for i in range(len(keys))]
    assert column(runs.adjacent_difference(df, "v", "pos", tile=tile), "diff") == [None, *[b - a for a, b in itertools.pairwise(squares)]]
    assert column(runs.shift(df, "v", "pos", 3, "s", tile=tile), "s") == [None] * 3 + squares[:-3]
    assert column(runs.shift(df, "v", "pos", -1, "s", tile=tile), "s") == [*squares[1:], None]
    assert column(runs.shift(df, "v", "pos", 2, "s", rotate=True, tile=tile), "s") == squares[-2:] + squares[:-2]


@pytest.mark.parametrize("tile", [2, 1 << 20])
def test_runs_within_segments(spark, tile):
    rows = [(i, rng.randrange(2), 0 if i % 6 else 1) for i in range(60)]
    df = spark.createDataFrame([(3 * i, k, s) for i, k, s in rows], "pos long, key long, seg int")
    got = {(r.seg, r.run): (r["key"], r["length"]) for r in runs.run_length_encode(df, "key", "pos", "seg", tile=tile).collect()}
    assert got == {(s, n): (k, size) for s in (0, 1) for n, (k, _, size) in enumerate(brute_runs([k for _, k, x in rows if x == s]), 1)}
    moved = {r.pos: r.s for r in runs.shift(df, "pos", "pos", 2, "s", "seg", tile=tile).collect()}
    for s in (0, 1):
        mine = [3 * i for i, _, x in rows if x == s]
        assert [moved[p] for p in mine] == [None, None, *mine[:-2]]


@pytest.mark.parametrize("tile", [2, 1 << 20])
def test_sums_between_flags(spark, tile):
    for flagged in ({0, 2}, {3, 4, 9}, set()):
        df = spark.createDataFrame([(5 * i, i + 1, i in flagged) for i in range(12)], "pos long, val int, f boolean")
        heads, tails = list(itertools.accumulate(int(i in flagged) for i in range(12))), [sum(j in flagged for j in range(i)) for i in range(12)]
        total = lambda marks: [sum(j + 1 for j in range(12) if marks[j] == m) for m in marks]
        assert column(runs.head_segmented_sum(df, "val", "f", "pos", tile=tile), "total") == total(heads)
        assert column(runs.tail_segmented_sum(df, "val", "f", "pos", tile=tile), "total") == total(tails)


def test_selection(spark):
    values = [rng.randrange(100) for _ in range(14)]
    front, back = [v for v in values if v < 50], [v for v in values if v >= 50]
    by_out = lambda df: [(r.out_pos, r.val) for r in df.orderBy("out_pos").collect()]
    for start, step in ((0, 1), (10, 1), (-9, 7)):
        df = spark.createDataFrame([(start + step * i, v, 1) for i, v in enumerate(values)], "pos long, val long, __hit int")
        assert by_out(select.select_if(df, F.col("val") < 50, "pos", tile=3)) == list(enumerate(front))
        both = select.partition_if(df, F.col("val") < 50, "pos", tile=3)
        assert both.columns == ["pos", "val", "__hit", "selected", "out_pos"] and by_out(both) == list(enumerate(front + back[::-1]))
        flag = df.selectExpr("pos", "int(val < 50) AS flag")
        assert by_out(select.select_flagged(df, flag, "pos")) == list(enumerate(front))
        assert by_out(select.partition_flagged(df, flag, "pos")) == list(enumerate(front + back[::-1]))


def test_histograms(spark):
    samples = [rng.uniform(-3, 30) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in samples], "x double")
    inside = lambda low, high: sum(low <= x < high for x in samples)
    assert column(histogram.histogram_even(df, "x", 0.0, 24.0, 6), "n", "bin") == [inside(4 * k, 4 * k + 4) for k in range(6)]
    for levels in ([0.0, 1.0, 5.0, 5.5, 21.0], [k * k / 200 for k in range(72)]):
        assert column(histogram.histogram_range(df, "x", levels), "n", "bin") == [inside(a, b) for a, b in itertools.pairwise(levels)]
    multi = histogram.multi_histogram(df, {"e": (histogram.even_bin(F.col("x"), 0.0, 12.0, 2), 2), "r": (histogram.range_bin(F.col("x"), [0.0, 1.0]), 1)})
    assert [(r.channel, r["bin"], r.n) for r in multi.orderBy("channel", "bin").collect()] == [("e", 0, inside(0, 6)), ("e", 1, inside(6, 12)), ("r", 0, inside(0, 1))]


def test_spmv_of_a_grid(spark):
    """Each cell of a grid is linked with its neighbours to the left, right, above and below."""
    wide, high = 5, 4
    near = {(x, y): [(x + i, y + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + i < wide and 0 <= y + j < high] for x in range(wide) for y in range(high)}
    number = {cell: k for k, cell in enumerate(near)}
    matrix = spark.createDataFrame([(number[a], number[b], 2) for a, bs in near.items() for b in bs], "row long, col long, val int")
    vector = spark.createDataFrame([(k, k + 1) for k in number.values()], "col long, x int")
    expected = [sum(2 * (number[b] + 1) for b in bs) for bs in near.values()]
    assert column(reduce.spmv(matrix, vector), "y", "row") == expected
    assert column(reduce.spmv(matrix, vector, len(near) + 2), "y", "row") == [*expected, 0, 0]
    assert column(reduce.spmv(matrix.union(matrix), vector, matrix.where("row < 3")), "y", "row") == [2 * y for y in expected[:3]]


def test_scalars(array):
    df = array([-2, -1, 0, 1, 2, 3, 4, 5, 8, 9])
    assert column(maps.transform(df, "val", scalar.floor_power_of_two), "out") == [0, 0, 0, 0, 1, 2, 2, 4, 4, 8]
    assert column(maps.transform(df, "val", scalar.ceil_power_of_two), "out") == [1, 1, 1, 1, 2, 4, 4, 8, 8, 16]
    assert column(maps.transform(df, "val", scalar.exact_log2), "out") == [-1, -1, -1, 0, 1, -1, 2, -1, 3, -1]
    assert column(maps.transform(df, "val", lambda x: scalar.bucket(x - 3, 8)), "out")[0] == 3
    assert column(maps.add_relations(array([1, 2]), array([10, 20]), "pos", "val"), "out") == [11, 22]
    loop = lambda x, k: int(4 * sum((i + x) / (2 * k * 0.29 + 1.33) for i in range(k + 1)))
    got = column(maps.transform(df, "val", lambda x: scalar.heavy_sum(x, 10)), "out")
    assert all(abs(g - loop(x, 10)) <= 1 for g, x in zip(got, [-2, -1, 0, 1, 2, 3, 4, 5, 8, 9], strict=True))


def test_column_pruning(spark, tmp_path):
    spark.range(10).selectExpr("id AS pos", "id AS val", "id AS other").write.parquet(str(tmp_path / "t"))
    df = scan.exclusive_sum(spark.read.parquet(str(tmp_path / "t")).select("pos", "val"), "val", "pos")
    assert inspect.read_columns(df) == ["pos", "val"]


def test_inspection_and_sinks(spark, tmp_path):
    from stridex.sources import tables

    df = spark.range(10).selectExpr("id + 1 AS x")
    assert "WholeStageCodegen" in inspect.generated_code(df) and inspect.operators(df) == ["Project", "Range"]
    tables.save(df, str(tmp_path / "t.parquet"))
    assert sorted(r.x for r in tables.download(tables.table(spark, str(tmp_path), "t"))) == list(range(1, 11))
    tables.discard(df)
    assert tables.upload(spark, [(1, 2)], "a int, b int").first() == (1, 2)


def test_variants_agree_on_random_input(spark):
    df = generate.uniform(spark, 500, 64, seed=9)
    keys = [r.val for r in df.orderBy("pos").collect()]
    runs_of = [(k, i) for i, k in enumerate(keys)]
    for tile in (7, 64, 1000):
        placed = split.place(df.withColumn("bucket", scalar.bucket(F.col("val"), 16)), "bucket", "pos", out="to", tile=tile)
        assert [r.pos for r in placed.orderBy("to").collect()] == [i for _, i in sorted((k & 15, i) for k, i in runs_of)]
        assert column(scan.exclusive_sum(df, "val", "pos", tile=tile), "scan") == [sum(keys[:i]) for i in range(500)]
    assert [r.val for r in sort.sort(df, "val", "pos").orderBy("rank").collect()] == sorted(keys)


@pytest.mark.parametrize("at_once", [3, 40, 10_000])
def test_median_narrows_to_the_exact_value(spark, array, at_once):
    values = [r.val for r in generate.uniform(spark, 999, 300, seed=3).collect()]
    for some in (values, values[:-1], [7] * 500 + [1], [2, 4], [5]):
        ordered = sorted(some)
        expected = (ordered[(len(some) - 1) // 2] + ordered[len(some) // 2]) / 2
        assert reduce.median(array(some), "val", at_once) == expected
    assert reduce.median(array([]), "val") is None
    assert reduce.hampel_mean(array([]), "val").first()["mean"] is None
