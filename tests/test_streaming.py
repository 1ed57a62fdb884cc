"""Streaming counts equal batch counts."""

from stridex.operators.split import histogram
from stridex.streaming.histogram import bucket_counts, windowed_counts


def test_bucket_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).selectExpr("id * 3 AS key").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("key long").option("maxFilesPerTrigger", 1).parquet(source)
    job = bucket_counts(stream, "key", 8).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    job.processAllAvailable()
    job.stop()
    batch = histogram(spark.read.parquet(source), "key", 8).where("n > 0")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_windowed_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).selectExpr("id AS key", "timestamp_seconds(id * 30) AS ts").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key long, ts timestamp").parquet(source)
    job = windowed_counts(stream, "key", 2, "ts", "1 minute", "0 seconds").writeStream.outputMode("append").format("memory").queryName("windows").start()
    job.processAllAvailable()
    job.stop()
    # The window that holds the last event stays open.
    assert spark.table("windows").selectExpr("sum(n)").first()[0] == 8
