"""Documents in blocks, and exact corpus-wide totals for the keys of each block without joining row by row.

A task takes its documents as they come and closes a block once it holds ``BLOCK_BYTES`` of text; a
block is one row, its documents compressed, so it is never cut again, whatever the ids: a null id, or
one that many rows share, gathers nothing.  The blocks are written once and need no shuffle to be read.

A block sends each of its distinct keys once, with its own count, to the shard that owns the key;
shards are ranges of the 64-bit key space, so they are even whatever the keys.  A shard adds up and
answers every block with totals in the order the keys came in, so answers carry no keys.  A key that
all documents hold costs one entry a block, a shard holds as much however large the corpus, and
nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridex.llm.common import groups_of, lean, materialize, partitions, release, small_batches

#: Bytes of text after which a block is closed: bounds what a task holds, but for a single longer text.
BLOCK_BYTES = 10_000_000
SHARDS_A_BLOCK = 2
SENT = "block long, kind int, shard int, n int, keys binary, counts binary"
ANSWER = "block long, kind int, shard int, n int, totals binary, n_keys long, n_total long, most long"
#: Of compression: blocks are written once, and shuffled once or twice.
LEVEL = 6
#: Blocks are large rows; small groups of them keep readers small.
ROW_GROUP = 16 << 20


@dataclass
class Blocks:
    """table: block, data; shards: how many parts the key space has, in proportion to the text and at least one a task."""

    table: DataFrame
    shards: int

    def each(self, body: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """What ``body(block, rows)`` gives for each block; no row moves."""

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                    yield from body(block, rows_of(data)).to_batches()

        return self.table.select("block", "data").mapInArrow(run, schema)

    def told(self, answers: DataFrame, body: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """What ``body(block, rows, answers to the block)`` gives; compressed blocks and answers are shuffled."""

        def run(own: pa.Table, got: pa.Table) -> pa.Table:
            try:
                return body(own["block"][0].as_py(), rows_of(own["data"][0]), got)
            finally:
                release()

        return self.table.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def rows_of(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def in_blocks(docs: DataFrame, name: str, block_bytes: int | None = None) -> Blocks:
    """The rows of ``docs`` (with a ``text``), all columns, in written blocks."""
    spark, limit = docs.sparkSession, block_bytes or BLOCK_BYTES
    small_batches(spark)

    def closed(held: list[pa.RecordBatch], block: int, size: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as writer:
            for batch in held:
                writer.write_batch(batch)
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "size": pa.array([size], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                upto = size + np.cumsum(pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(), dtype=np.int64)
                take = min(int(np.searchsorted(upto, limit)) + 1, batch.num_rows)
                held.append(batch.slice(0, take))
                batch, size = batch.slice(take), int(upto[take - 1])
                if size >= limit:
                    yield closed(held, block, size)
                    block, held, size = block + 1, [], 0
        if held:
            yield closed(held, block, size)

    table = materialize(docs.mapInArrow(deal, "block long, size long, data binary"), name, ROW_GROUP)
    size = table.agg(F.sum("size").alias("n")).first()["n"] or 0
    return Blocks(table, max(partitions(spark), SHARDS_A_BLOCK * -(-size // limit)))


def sent(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.Table:
    """A block's sorted distinct keys and counts as one row for each shard."""
    owner = shard_of(keys, shards)
    cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(keys) else np.zeros(1, np.int64)
    rows = owner[cuts[:-1]].tolist()
    part = lambda x: pa.array([squeezed(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    steps[cuts[:-1]] = keys[cuts[:-1]]
    return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "shard": pa.array(rows, pa.int32()), "n": pa.array(np.diff(cuts).astype(np.int32)), "keys": part(steps), "counts": part(counts.astype(np.uint32))})


def squeezed(values: np.ndarray) -> bytes:
    """Numbers with the bytes of one place side by side, compressed: most high bytes are zero."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def restored(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Non-decreasing in the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def totals(rows: DataFrame) -> DataFrame:
    """Answers to what the blocks sent.  n_keys, n_total and most (keys with a total above 0, their sum and the largest) stand once for each kind and task."""

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "shard"):
            kinds = table["kind"].to_numpy()
            for kind in np.unique(kinds):
                yield from answer(table.take(pa.array(np.flatnonzero(kinds == kind)))).to_batches()

    def answer(some: pa.Table) -> pa.Table:
        lengths = some["n"].to_numpy()
        keys = np.concatenate([np.cumsum(restored(x, n, np.uint64), dtype=np.uint64) for x, n in zip(some["keys"].to_pylist(), lengths, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        del keys
        counts = np.concatenate([restored(x, n, np.uint32) for x, n in zip(some["counts"].to_pylist(), lengths, strict=True)])
        sums = np.add.reduceat(counts[order], heads, dtype=np.uint64)
        found = np.empty(len(order), np.uint64)
        found[order] = np.repeat(sums, np.diff(np.r_[heads, len(order)]))
        ends = np.cumsum(lengths)
        once = lambda x: pa.array([int(x)] + [0] * (len(lengths) - 1), pa.int64())
        binary = pa.array([squeezed(found[e - n : e]) for e, n in zip(ends, lengths, strict=True)], pa.binary())
        return pa.table({"block": some["block"], "kind": some["kind"], "shard": some["shard"], "n": some["n"], "totals": binary, "n_keys": once((sums > 0).sum()), "n_total": once(sums.sum()), "most": once(sums.max())})

    # A task goes through its shards one after another, so it holds one at a time.
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, ANSWER)


def answered(table: pa.Table, kind: int) -> np.ndarray:
    """The totals of a block's keys of one kind, in the order of its sorted keys."""
    some = table.filter(pa.compute.equal(table["kind"], kind)).sort_by("shard")
    parts = [restored(x, n, np.uint64) for x, n in zip(some["totals"].to_pylist(), some["n"].to_pylist(), strict=True)]
    return np.concatenate([np.empty(0, np.uint64), *parts])
