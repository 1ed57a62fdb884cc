"""Looking at physical plans: for tests, and for deciding between strategies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    """Operator names of the physical plan, from the root down."""
    return re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", physical_plan(df), re.M)


def generated_code(df: DataFrame) -> str:
    """The Java source that whole-stage code generation makes for ``df``."""
    return df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")


def single_partition_rows(df: DataFrame) -> bool:
    """True if the plan moves rows to one partition."""
    return "SinglePartition" in physical_plan(df)


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    found = re.findall(r"ReadSchema: struct<([^>]*)>", physical_plan(df))
    return sorted({c.split(":")[0] for s in found for c in s.split(",") if c})
