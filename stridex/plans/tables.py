"""Tables that cut a plan: written once to the shared folder, read by every job after."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, which goes when Python ends.

    Where that setting is unset a folder of our own serves, on a local master only: executors of a
    cluster would each see their own disk there.
    """
    context = spark.sparkContext
    if context.applicationId in _OWN:
        return _OWN[context.applicationId]
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="stridex-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    jvm, own = context._jvm, f"{folder}/stridex-{context.applicationId}"
    path = jvm.org.apache.hadoop.fs.Path(own)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    _OWN[context.applicationId] = own

    def clear() -> None:
        try:
            system.delete(path, True)
        except Exception:  # the JVM has ended before us; nothing can be reached any more
            pass

    atexit.register(clear)
    return own


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` as a written table: later jobs neither repeat the work nor see other rows than this one did."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
