"""Connected components of a link table by joins: least labels spread to neighbours and jump through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridex.llm.common import discard, materialize

#: Parts that the rows of one label are dealt into.
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` for every id in links ``a, b``: comp is the smallest id reachable.

    Each round takes the least label among an id and its neighbours, then the label's own label, so
    long chains shorten fast.  Rounds end when the sum of labels stands still, as labels only fall.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    total = lambda df: df.agg(F.sum(F.col("comp").cast("decimal(38,0)")).alias("s")).first()["s"]
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")), "labels")
    before = total(labels)
    while before is not None:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.least("comp", "near").alias("comp"))
        # Labels of labels only, each for every salt, as a giant component has one label for all its ids.
        wanted = lower.select(F.col("comp").alias("id")).distinct()
        jump = labels.join(wanted, "id", "left_semi").select(F.col("id").alias("comp"), F.col("comp").alias("further"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = lower.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        new = materialize(salted.join(jump, ["comp", "salt"], "left").select("id", F.least("comp", "further").alias("comp")), "labels")
        after = total(new)
        discard(labels)
        labels = new
        if after == before:
            break
        before = after
    discard(both)
    return labels
