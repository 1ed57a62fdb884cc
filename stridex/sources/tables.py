"""Reading the driver's tables and other files, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def upload(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows of the driver as a DataFrame; for small inputs."""
    return spark.createDataFrame(rows, schema)


def download(df: DataFrame) -> list:
    """Rows to the driver; for small results."""
    return df.collect()


def save(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite", **options) -> None:
    df.write.format(file_format).mode(mode).options(**options).save(path)


def discard(df: DataFrame) -> None:
    """Runs a plan and drops its rows; the sink for measuring."""
    df.write.format("noop").mode("overwrite").save()
