"""Temperature mixing: source shares raised to an exponent, realised as budgeted permutations of blocks.

A source's weight is its token share to the power ``alpha``, normalised; alpha falls from 1 (as is)
towards 0 (all alike) until the entropy of the weights reaches a target, unless some source would be
repeated more often than a limit first.  Both grow as alpha falls, so alpha is found by narrowing an
interval, with sums over the source table taken by Spark.

A source's budget is its weight times all tokens to be realised.  Whole multiples of the source are
full passes; the rest comes from the source's blocks (documents by a hash of their id) in a permuted
order, whole blocks while they fit and then documents of the next block in a permuted order while
they fit.  So a source misses its budget by less than one document of that block.  A pass reads the
blocks in that order: each document comes with its ``block``, the block's place in the permutation
(``block_rank``) and a number that orders the documents within the block (``order_key``).

Tokens are words.  Defined cases: a null source is a source of its own; a null or empty text has no
tokens and follows its block; rows with one id and source count as one document and get the same
number of copies; ties of hashes go to the smaller block and id; an empty table gives no rows; a very
long text is one document, never cut; other columns pass through ``realise`` untouched, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridex.llm.common import materialize, release_shuffles
from stridex.operators.tiles import fresh

#: Share of the greatest possible entropy, log of the number of sources, to reach.
TARGET_ENTROPY = 0.9
REPEAT_LIMIT = 2.0
#: Tokens to realise, as a share of all tokens.
BUDGET = 1.0
#: Tokens in a block.  The blocks of one source, a row each, are put in order by one task.
BLOCK_TOKENS = 100_000
SEED = 17
#: Source tables up to this number of rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text"):
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def spread(sources: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights, and the largest ratio of weight to share, for each exponent.  sources: share > 0."""
    sums = []
    for k, a in enumerate(alphas):
        power = F.pow("share", F.lit(a))
        sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("share")).alias(f"s{k}"), F.max(power / F.col("share")).alias(f"r{k}")]
    row = sources.agg(*sums).first()
    return [(math.log(row[f"z{k}"]) - a * row[f"s{k}"] / row[f"z{k}"], row[f"r{k}"] / row[f"z{k}"]) for k, a in enumerate(alphas)]


def exponent(sources: DataFrame, target: float, repeats: float, budget: float, rounds: int = 10, cuts: int = 8) -> float:
    """The largest alpha in [0, 1] whose entropy reaches ``target``, or the smallest that keeps to ``repeats`` if that is larger."""

    def narrowed(low: float, high: float, enough) -> tuple[float, float]:
        # enough holds below some point; each round takes the sums for several exponents at once.
        for _ in range(rounds):
            grid = [low + (high - low) * k / cuts for k in range(1, cuts)]
            good = [a for a, x in zip(grid, spread(sources, grid), strict=True) if enough(x)]
            low, high = max(good, default=low), min((a for a in grid if a not in good), default=high)
        return low, high

    (flat_h, flat_r), (as_is_h, _) = spread(sources, [0.0, 1.0])
    by_entropy = 1.0 if as_is_h >= target else 0.0 if flat_h <= target else narrowed(0.0, 1.0, lambda x: x[0] >= target)[0]
    by_limit = 0.0 if flat_r * budget <= repeats else narrowed(0.0, 1.0, lambda x: x[1] * budget > repeats)[1]
    return max(by_entropy, by_limit)


def weigh(units: DataFrame, target_entropy: float = TARGET_ENTROPY, repeats: float = REPEAT_LIMIT, budget: float = BUDGET) -> DataFrame:
    """source, tokens, weight, passes (full ones), rest (tokens beyond them) and blocks, from units (source, n_tokens)."""
    sources = materialize(units.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total, n = sources.agg(F.sum("tokens"), F.count(F.when(F.col("tokens") > 0, 1))).first()
    if not total:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(0.0).alias("rest"), F.lit(1).cast("long").alias("blocks"))
    shares = sources.withColumn("share", F.col("tokens") / F.lit(total))
    some = shares.where("share > 0")
    alpha = exponent(some, target_entropy * math.log(n), repeats, budget)
    z = some.agg(F.sum(F.pow("share", F.lit(alpha)))).first()[0]
    weighed = shares.withColumn("weight", F.when(F.col("share") > 0, F.pow("share", F.lit(alpha)) / F.lit(z)).otherwise(0.0))
    goal = F.col("weight") * F.lit(float(total) * budget)
    passes = F.when(F.col("tokens") > 0, F.floor(goal / F.col("tokens") + 1e-9)).otherwise(F.lit(1)).cast("long")
    rest = F.greatest(F.lit(0.0), goal - F.col("passes") * F.col("tokens"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    return weighed.withColumn("passes", passes).select("source", "tokens", "weight", "passes", rest.alias("rest"), blocks.alias("blocks"))


def mix(units: DataFrame, **parameters) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, block_rank, order_key, copies, one row per id and source, from a table (doc_id, source, n_tokens)."""
    units = materialize(units.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")), "units")
    sources = materialize(weigh(units, **parameters), "weights")
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    table = (F.broadcast(sources) if small else sources).withColumnRenamed("source", "s").drop("tokens")
    block = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("blocks"))
    dealt = units.join(table, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", block)
    sums = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("limit"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(SEED)), "block").rowsBetween(Window.unboundedPreceding, 0)
    # One row a block: this window never holds a source's documents.
    ranked = sums.withColumns({"upto": F.sum("size").over(order), "rank": F.count(F.lit(1)).over(order) - 1})
    room = F.col("limit") - (F.col("upto") - F.col("size"))
    taken = ranked.select(F.col("source").alias("s"), F.col("block").alias("b"), F.when(room > 0, room).alias("room"), (F.col("upto") <= F.col("limit")).alias("whole"), F.col("rank").alias("block_rank"))
    placed = dealt.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    placed = materialize(placed.withColumn("order_key", F.xxhash64("doc_id", F.lit(SEED + 1))), "placed")
    release_shuffles(units.sparkSession)
    rank = Window.partitionBy("source", "block").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # Documents are put in order in the one block a source that is taken in part.
    edge = placed.where("room IS NOT NULL AND NOT whole").withColumn("extra", (F.sum("n_tokens").over(rank) <= F.col("room")).cast("long"))
    plain = placed.where("room IS NULL OR whole").withColumn("extra", F.when(F.col("room").isNotNull(), 1).otherwise(0).cast("long"))
    return plain.unionByName(edge).select("doc_id", "source", "n_tokens", "weight", "block", "block_rank", "order_key", (F.col("passes") + F.col("extra")).alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", word_count().alias("n_tokens")))


def realise(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` with each row as often as decided."""
    i, source, copies, copy = fresh(docs.columns, "id", "source", "copies", "copy")
    times = decisions.where("copies > 0").select(F.col("doc_id").alias(i), F.col("source").alias(source), F.col("copies").alias(copies))
    met = docs.join(times, F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(source)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with each document as often as its source's weight asks; none that its source has no room for.

    Nulls, repeated rows, ties and empty tables are as above; all columns pass through.
    """
    return realise(docs, mix(docs.select("doc_id", "source", word_count().alias("n_tokens"))))
