"""The corpus pipeline: five of the operators in a row, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stridex.llm import host_rules, minhash, mixing, packing, substrings
from stridex.llm.common import materialize

STAGES = [
    ("quality_rules", host_rules.stage),
    ("near_duplicates", minhash.stage),
    ("repeated_passages", substrings.stage),
    ("temperature_mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]
#: Shingle joins, suffix groups and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document that is left goes, after all stages over the whole of ``documents``.

    What a stage does with nulls, empty and very long texts, ties, repeated rows and clashing columns
    stands in its own docstring; an empty table gives no rows.  A stage's table is written before the
    next one reads it, so a lost executor costs tasks of one stage only.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
