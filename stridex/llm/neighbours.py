"""Approximate nearest neighbours by cosine: NN-descent builds the graph, greedy search answers queries.

Equal vectors form a class; its smallest id is the node, and its few smallest ids answer for it, so
copies in any number cost nothing.  The graph starts from several
deals into small random groups.  Each round joins
every node with its neighbours and a sample of reverse neighbours, compares those with each other
(neighbours of neighbours; a pair of which neither entry is new was met before and is left out, and
a node with no new entry takes no part), sends each the best it met, and keeps the best ``K`` a node;
rounds end when few entries change.  What a node hears is cut to its best ``K`` within each task
before it is sent, so a hub hears ``K`` from each task and not ``TOLD`` from each node that lists it.  A query is a row of the table: it enters at its own node and that node's
neighbours, and each step expands its best unexpanded nodes by joins with the graph, until ``STEPS`` or nothing is
left.  Graph and search compare 32-bit forms of the vectors in double precision and hold the cosine
less one, so that near-copies are told apart; all of the best ``POOL`` are then ranked by the
exact cosine of the original vectors in double precision.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids; with few vectors all candidates are returned;
ties go to the smaller id; rows that repeat an id are one vector if equal, and the id's smallest
vector by bytes counts if not; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridex.llm.common import discard, groups_of, materialize, partitions, release_shuffles, small_batches

K = 40
REVERSE = 20
#: Best partners that a node is told of from one local join.
TOLD = 8
ROUNDS = 8
#: Rounds end when less than this share of all entries is new.
SETTLED = 0.01
GROUP, GROUPINGS = 64, 3
EXPAND, STEPS, POOL = 40, 3, 120
#: Below any cosine less one.
NEVER = -3.0


def prepare(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, key (of the vector's bytes), exact (double bytes) and short (32-bit components, scaled by a power of two)."""
    small_batches(vectors.sparkSession, 5000)
    sizes = vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 0

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, exact, short = [], [], [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.array(v, np.float64)  # nulls become nan
                if not np.isfinite(x).all() or not x.any():
                    continue
                ids.append(i), exact.append((x + 0.0).tobytes()), keys.append(hashlib.blake2b(exact[-1], digest_size=16).digest())
                # Components that were 32-bit before stay as they are, but for those too small to count.
                short.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.binary()) for x in (keys, exact, short))], names=["id", "key", "exact", "short"])

    usable = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return usable.mapInArrow(compute, "id long, key binary, exact binary, short binary").groupBy("id").agg(F.min(F.struct("key", "exact", "short")).alias("r")).select("id", "r.*")


def units(column, rows: int | None = None) -> np.ndarray:
    """32-bit components as unit rows in double precision."""
    x = np.frombuffer(b"".join(column), np.float32).reshape(rows or len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stored(table: pa.Table, column: str) -> np.ndarray:
    """``units`` of a column of equally long values, straight from its buffer."""
    array = table[column].combine_chunks()
    size = len(array[0].as_py())
    raw = np.frombuffer(array.buffers()[2], np.uint8)
    first = np.frombuffer(array.buffers()[1], np.int32)[array.offset]
    return units([raw[first : first + size * len(array)].tobytes()], len(array))


def bounds(keys: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def listed(ids: np.ndarray, sizes: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row an id, with its ``sizes`` next values of each column as lists."""
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["id", *columns])


CANDIDATES = "id long, near array<long>, sim array<float>"
GRAPH = CANDIDATES + ", new array<boolean>"


def local_join(rows: DataFrame, told: int) -> DataFrame:
    """Per node ``v`` compare its members (u, short, least, new), new ones with all; each hears of its best, if better than ``least``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "v"):
            cuts = bounds(table["v"].to_numpy())
            u, least, x = table["u"].to_numpy(), table["least"].to_numpy(), stored(table, "short")
            new = table["new"].to_numpy(zero_copy_only=False).astype(bool)
            ids, sizes, near, sims = ([np.empty(0, t)] for t in (np.int64, np.int64, np.int64, np.float32))
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2:
                    continue
                s = (x[a:b] @ x[a:b].T - 1).astype(np.float32)
                s[~(new[a:b, None] | new[None, a:b])] = 2 * NEVER
                np.fill_diagonal(s, 2 * NEVER)
                t = min(told, b - a - 1)
                best = np.argpartition(-s, t - 1, axis=1)[:, :t]
                value = np.take_along_axis(s, best, 1)
                good = value > least[a:b, None]
                hears = good.sum(1)
                ids.append(u[a:b][hears > 0]), sizes.append(hears[hears > 0]), near.append(u[a:b][best][good]), sims.append(value[good])
            yield listed(np.concatenate(ids), np.concatenate(sizes), near=np.concatenate(near), sim=np.concatenate(sims))

    return rows.sortWithinPartitions("v").mapInArrow(join, CANDIDATES)


def merged(candidates: DataFrame, count: int) -> DataFrame:
    """Per id of a partition the ``count`` best distinct of its lists; ``new`` are those that no list with ``old`` holds."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "id"):
            near, sim = table["near"].combine_chunks(), table["sim"].combine_chunks()
            each = np.diff(near.offsets.to_numpy())
            keys, near, sim = np.repeat(table["id"].to_numpy(), each), near.flatten().to_numpy(), sim.flatten().to_numpy()
            new = ~np.repeat(table["old"].to_numpy(zero_copy_only=False).astype(bool), each)
            # Of equal neighbours the old one stays, then the best of each id.
            by = np.lexsort((new, near, keys))
            by = by[np.r_[True, (near[by][1:] != near[by][:-1]) | (keys[by][1:] != keys[by][:-1])]] if len(by) else by
            by = by[np.lexsort((near[by], -sim[by], keys[by]))]
            cuts = bounds(keys[by]) if len(by) else np.zeros(1, np.int64)
            by = by[np.arange(len(by)) - np.repeat(cuts[:-1], np.diff(cuts)) < count]
            yield listed(np.unique(keys[by]), np.minimum(np.diff(cuts), count), near=near[by], sim=sim[by], new=new[by])

    return candidates.sortWithinPartitions("id").mapInArrow(merge, GRAPH)


def keep_best(told: DataFrame, count: int, graph: DataFrame | None = None) -> DataFrame:
    """Per id the ``count`` best of ``graph`` and of what it was told, which is cut within each task before it is sent."""
    lists = lambda df, flag: df.select("id", "near", "sim", F.lit(flag).alias("old"))
    heard = lists(merged(lists(told, False), count), False)
    every = heard if graph is None else lists(graph, True).union(heard)
    return merged(every.repartition(partitions(told.sparkSession), "id"), count)


def members(graph: DataFrame, reverse: int, salt: int) -> DataFrame:
    """(v, u, new): per node its neighbours and a sample of reverse ones, new ones first, if any of them is new."""
    forward = graph.select(F.col("id").alias("v"), F.explode(F.arrays_zip(F.col("near").alias("u"), F.col("new"))).alias("e")).select("v", F.col("e.u").alias("u"), F.col("e.new").alias("new"))
    pick = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64("v", "u", F.lit(salt)), "u"))
    backward = forward.select(F.col("u").alias("v"), F.col("v").alias("u"), "new").withColumn("n", pick).where(F.col("n") <= reverse).drop("n")
    # Neighbours and the sample, so the two lists are short.
    sets = forward.union(backward).groupBy("v").agg(F.collect_set(F.when(F.col("new"), F.col("u"))).alias("fresh"), F.collect_set(F.when(~F.col("new"), F.col("u"))).alias("known"))
    with_news = sets.where(F.size("fresh") > 0).withColumn("known", F.array_except("known", "fresh"))
    flagged = lambda c, flag: F.transform(c, lambda u: F.struct(u.alias("u"), F.lit(flag).alias("new")))
    return with_news.select("v", F.explode(F.concat(flagged("fresh", True), flagged("known", False))).alias("e")).select("v", "e.u", "e.new")


def build(nodes: DataFrame, k: int = K, reverse: int = REVERSE, rounds: int = ROUNDS) -> DataFrame:
    """The graph (id, near, sim, new) of ``nodes`` (id, short)."""
    spark, n = nodes.sparkSession, nodes.count()
    tasks = partitions(spark)
    small_batches(spark, 5000)
    # Several independent groupings, as one alone would leave each group to itself.
    dealt = F.array(*[F.pmod(F.xxhash64("id", F.lit(g)), F.lit(max(1, n // GROUP))) * GROUPINGS + g for g in range(GROUPINGS)])
    start = nodes.select(F.explode(dealt).alias("v"), F.col("id").alias("u"), "short", F.lit(NEVER).cast("float").alias("least"), F.lit(True).alias("new"))
    graph = materialize(keep_best(local_join(start.repartition(tasks, "v"), k), k), "graph")
    for r in range(rounds if n > 2 * GROUP else 0):
        least = F.when(F.size("near") >= k, F.array_min("sim")).otherwise(F.lit(NEVER).cast("float"))
        member = nodes.join(graph.select("id", least.alias("least")), "id").select(F.col("id").alias("u"), "short", "least")
        met = members(graph, reverse, r).join(member, "u").repartition(tasks, "v")
        newer = materialize(keep_best(local_join(met, TOLD), k, graph), "graph")
        discard(graph)
        graph = newer
        release_shuffles(spark)
        if graph.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] < SETTLED * n * k:
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, steps: int = STEPS, expand: int = EXPAND, pool: int = POOL) -> DataFrame:
    """id, near, sim: the pool that greedy search finds for ``queries`` (id, short, entry: array of node ids)."""
    spark = queries.sparkSession
    tasks = partitions(spark)
    state = queries.select("id", "short", F.col("entry").alias("next"), F.array().cast("array<long>").alias("near"), F.array().cast("array<float>").alias("sim"), F.array().cast("array<long>").alias("done"))
    schema = "id long, short binary, next array<long>, near array<long>, sim array<float>, done array<long>"

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A query's own row comes first (u is null), then the nodes that it met.
        for table in groups_of(batches, "id"):
            cuts = bounds(table["id"].to_numpy())
            out = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = table.slice(a, 1).to_pylist()[0]
                done = set(own["done"]) | set(own["next"])
                near, sim = np.array(own["near"], np.int64), np.array(own["sim"], np.float32)
                if b - a > 1:
                    met = table.slice(a + 1, b - a - 1)
                    found = met["u"].to_numpy()
                    near, sim = np.r_[near, found], np.r_[sim, (units(met["node"].to_pylist()) @ units([own["short"]])[0] - 1).astype(np.float32)]
                    near, first = np.unique(near, return_index=True)
                    top = np.lexsort((near, -sim[first]))[:pool]
                    near, sim = near[top], sim[first][top]
                following = [x for x in near.tolist() if x not in done][:expand]
                out.append({"id": own["id"], "short": own["short"], "next": following, "near": near.tolist(), "sim": sim.tolist(), "done": sorted(done)})
            yield from pa.Table.from_pylist(out, schema=pa.schema([("id", pa.int64()), ("short", pa.binary()), ("next", pa.list_(pa.int64())), ("near", pa.list_(pa.int64())), ("sim", pa.list_(pa.float32())), ("done", pa.list_(pa.int64()))])).to_batches()

    for step in range(steps + 1):
        asked = state.select("id", F.explode("next").alias("at"))
        # The first step meets the entries themselves, later ones the neighbours of what is expanded.
        met = asked.select("id", F.col("at").alias("u")) if not step else asked.join(graph.select(F.col("id").alias("at"), "near"), "at").select("id", F.explode("near").alias("u")).distinct()
        with_node = met.join(nodes.select(F.col("id").alias("u"), F.col("short").alias("node")), "u")
        own = state.withColumns({"u": F.lit(None).cast("long"), "node": F.lit(None).cast("binary")}) if step else state.withColumns({"u": F.lit(None).cast("long"), "node": F.lit(None).cast("binary"), "next": F.array().cast("array<long>")})
        none = {c: F.lit(None).cast(own.schema[c].dataType) for c in ("short", "next", "near", "sim", "done")}
        rows = own.unionByName(with_node.withColumns(none))
        new = materialize(rows.repartition(tasks, "id").sortWithinPartitions("id", F.col("u").asc_nulls_first()).mapInArrow(advance, schema), "pool")
        if step:
            discard(state)
        state = new
        release_shuffles(spark)
    return state.select("id", "near", "sim")


def nearest(vectors: DataFrame, is_query, count: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``is_query`` holds of their id, the ``count`` nearest other rows."""
    spark = vectors.sparkSession
    table = materialize(prepare(vectors, id_col, vec_col), "vectors")
    # A class is cut to its smallest ids before the shuffle (WindowGroupLimit); one more than asked, as a query may be among them.
    order = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    members = materialize(table.select("id", "key").withColumn("n", order).where(F.col("n") <= count + 1), "members")
    reps = members.where("n = 1").select(F.col("id").alias("rep"), "key")
    nodes = materialize(table.join(reps, (table.id == reps.rep) & (table.key == reps.key)).select("id", "short", "exact"), "nodes")
    graph = build(nodes.select("id", "short"))
    asked = table.where(is_query(F.col("id"))).select("id", "key").join(reps, "key").select("id", "rep")
    wanted = asked.select("rep").distinct()
    entries = nodes.join(graph.select("id", "near"), "id").join(wanted, F.col("id") == F.col("rep")).select("id", "short", F.concat(F.array("id"), "near").alias("entry"))
    alone = nodes.join(wanted, F.col("id") == F.col("rep")).join(graph.select("id"), "id", "left_anti").select("id", "short", F.array("id").alias("entry"))
    found = materialize(search(materialize(entries.union(alone), "entries"), graph, nodes.select("id", "short")), "found")
    # The whole pool is ranked exactly.
    few = found.select(F.col("id").alias("q"), F.explode(F.array_union(F.array("id"), "near")).alias("u"))
    exact = few.join(nodes.select(F.col("id").alias("u"), F.col("exact").alias("x")), "u").join(nodes.select(F.col("id").alias("q"), F.col("exact").alias("y")), "q")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(len(batch), -1) for c in "xy")
            dot = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("u"), pa.array(dot)], names=["q", "u", "score"])

    scored = exact.mapInArrow(cosine, "q long, u long, score double")
    copies = members.join(reps, "key").select(F.col("rep").alias("u"), F.col("id").alias("vec_id"))
    by_rep = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    short = scored.join(copies, "u").withColumn("n", F.row_number().over(by_rep)).where(F.col("n") <= count + 1)
    answers = short.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    others = asked.join(answers, asked.rep == answers.q).select(F.col("id").alias("query_id"), F.expr(f"slice(filter(best, b -> b.vec_id != id), 1, {count})").alias("best"))
    id_type = vectors.schema[id_col].dataType
    ranked = others.select("query_id", F.posexplode("best").alias("p", "b"))
    return ranked.select(F.col("query_id").cast(id_type), (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").cast(id_type).alias("vec_id"), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, 5)
