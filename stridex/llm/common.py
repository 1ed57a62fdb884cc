"""What the corpus operators share: shared-folder tables, word splitting and hashing, folds.

Words are maximal runs of bytes other than ``0x20`` and ``0x09``-``0x0D``; ``bytes.split()``
separates on exactly those six, so texts are handled as UTF-8 bytes throughout.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.plans.tables import shared_dir

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Entries that a worker's word cache holds before it starts anew (about 90 MB).
CACHE_ENTRIES = 500_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    The files outlive any executor, and a stage that is run again reads the same rows.  They go with
    the folder when Python ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The shuffle files of this write go with it, rather than when the driver next collects garbage.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.option("parquet.block.size", str(row_group)) if row_group else writer).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete the shuffle files of jobs that have ended."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their workers import it by name."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="stridex-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/stridex.zip", "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/stridex.zip")
    _SHIPPED.add(context.applicationId)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows and bytes in one Arrow batch: texts can be long, and a worker holds a batch at a time."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


#: Memories of this worker that outlive a task, see ``lean``.
KEPT: list[dict] = []


def release() -> None:
    """Give freed memory back to the system: the allocators keep it for later, and an idle worker's counts with all others'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forget() -> None:
    for memory in KEPT:
        memory.clear()


def lean(body=None, *, keep: bool = False):
    """Of a function over batches: its task leaves a small worker, and, unless ``keep`` is set, starts without what tasks of other operators remembered."""
    if body is None:
        return functools.partial(lean, keep=keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Called by name: a function that is sent to a worker takes copies of the lists that it names itself.
        if not keep:
            forget()
        try:
            yield from body(batches)
        finally:
            release()

    return run


def fold(column: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def held_out(column: str, parts: int, rest: int) -> Column:
    return F.coalesce(fold(column, parts) == rest, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHash(dict):
    """64-bit hash of a word, remembered; the memory is bounded by starting anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * MIX + hashes[k : k + n]
    return mixed(out)


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of one key, from batches sorted by it; many groups at a time, none cut."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = table[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def reads(table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet")
