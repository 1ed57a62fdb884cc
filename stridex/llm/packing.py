"""Sum-of-squares packing of tokenized documents into fixed-length sequences.

A document's ids are those of the tokenizer followed by one end id; a document longer than the
capacity is cut into full pieces and a rest.  Pieces are dealt into groups of a fixed mean size and
each group is packed by itself: a piece goes where the sum over residual gaps of (open bins with
that gap) squared becomes smallest, a new bin being one of the choices.  A group is packed in a few
orders (long pieces first by length, short ones after them in hash order, for several bounds between
long and short) until one needs no more bins than the sum of lengths does; else the best stands.

Every bin of a group but a handful ends nearly full, so the loss against packing all pieces
together is a few bins in ``GROUP_PIECES``.  Defined cases: a null text is empty and holds the end
id alone; repeated rows are packed each on its own; an empty table gives no rows; a null doc_id is
carried along; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stridex.llm.common import KEPT, lean, materialize, small_batches

CAPACITY = 2048
END_ID = 0
#: Mean number of pieces packed together; a worker holds some 50 bytes for each.
GROUP_PIECES = 50_000
#: Units that a worker remembers, some 200 bytes each.
CACHE_UNITS = 1_000_000
#: Pieces of at least capacity / divisor count as long; 0 sorts all by length.
LONG_DIVISORS = (8, 16, 4, 6, 12, 32, 3, 0)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Texts without any of these characters are cut into the tokenizer's units here; other words go to it whole.
_OTHER = re.compile("[^\\t-\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
#: Fixed: the tokenizer's splitting pattern, for lower-cased text of those characters.
_UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\t-\\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
_WORD_END = "</w>"
#: May begin a special token, which the tokenizer finds before it cuts.
_SPECIAL = "<|"


def units_of(text: str) -> list[str]:
    """What the tokenizer cuts a text into, lower-cased; a word that can't be cut here stands whole, as it is."""
    if not _OTHER.search(text) and _SPECIAL not in text:
        return _UNIT.findall(text.lower())
    out = []
    for word in text.encode().split():
        w = word.decode()
        out += [w] if _SPECIAL in w or _OTHER.search(w) else _UNIT.findall(w.lower())
    return out


class UnitIds(dict):
    """Ids of a unit as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins across units, so a text's ids are those of its
    units in turn, and most units are met again and again.  All new units of a chunk are tokenized
    in one call: each ends in its only token with the word-end mark.  When full, the memory keeps
    the units that came in more than one chunk.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith(_WORD_END)]] = True
        self.again: set[str] = set()

    def learn(self, units: set[str]) -> None:
        new = units.difference(self)
        self.again |= units.difference(new)
        if len(self) + len(new) > CACHE_UNITS:
            kept = {u: self[u] for u in self.again} if len(self.again) < CACHE_UNITS // 2 else {}
            self.clear(), self.again.clear()
            self.update(kept)
            new = units.difference(self)
        joined = " ".join(new)
        whole = [u for u in new if _SPECIAL in u or _OTHER.search(u)] if _SPECIAL in joined or _OTHER.search(joined) else []
        rest = list(new.difference(whole))
        for k in range(0, len(rest), 2000):
            some = rest[k : k + 2000]
            ids = np.array(self._encode([" ".join(some)])[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(some):
                data = ids.tobytes()
                self.update([(u, data[i:j]) for u, i, j in zip(some, [0, *ends], ends, strict=False)])
            else:
                whole += some
        for u, e in zip(whole, self._encode(whole), strict=True):
            self[u] = np.array(e.ids, "<u4").tobytes()

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


_LOADED: dict[str, UnitIds] = {}
KEPT.append(_LOADED)


def unit_ids(path: str) -> UnitIds:
    """This worker's memory for a tokenizer file; it outlives the task, until a task of another operator comes."""
    if path not in _LOADED:
        _LOADED[path] = UnitIds(path)
    return _LOADED[path]


def token_bytes(texts: list[bytes | None], ids: UnitIds, chunk: int = 4_000_000) -> Iterator[bytes]:
    """The ids of each text, without the end id; texts are taken a few at a time to bound the units held."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(units_of((text or b"").decode()))
        size += len(text or b"")
        if size >= chunk or k == len(texts) - 1:
            ids.learn(set().union(*held))
            for units in held:
                yield b"".join(map(ids.__getitem__, units))
            held, size = [], 0


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids as 32-bit little-endian bytes."""
    path = path or tokenizer_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession)

    @lean(keep=True)
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = unit_ids(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows, piece, start, length, crc, parts = [], [], [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for row, tokens in enumerate(token_bytes(texts, ids)):
                tokens += end
                for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[at : at + 4 * capacity]
                    rows.append(row), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if keep_ids:
                        parts.append(part)
            columns = {"doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if keep_ids:
                columns["ids"] = pa.array(parts, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given, by the sum-of-squares rule; ties go to the smallest gap."""
    count = np.zeros(capacity + 1, np.int64)
    # Half of what the sum loses, but for a constant, if a bin leaves a gap; an empty gap can't be chosen.
    leave = np.full(capacity + 1, np.iinfo(np.int64).max // 4, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        # Change of the sum, less 2: twice (count[gap - size] - count[gap]); a gap that closes counts no more, which is 1 less.
        change = 2 * (leave[size:] + count[: capacity + 1 - size])
        change[0] -= 1
        gap = int(change.argmin()) + size
        if gap < capacity and change[gap - size] <= 2 * count[capacity - size] - 1:
            b = stacks[gap].pop()
            count[gap] -= 1
            leave[gap] = -count[gap] if count[gap] else np.iinfo(np.int64).max // 4
        else:
            gap, b, n = capacity, n, n + 1
        bins[k], offsets[k] = b, capacity - gap
        rest = gap - size
        if rest:
            stacks[rest].append(b)
            count[rest] += 1
            leave[rest] = -count[rest]
    return bins, offsets


def best_place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``place`` in the order, of those tried, that needs the fewest bins; results are by the given positions."""
    best, least = None, -(-int(lengths.sum()) // capacity)
    for divisor in LONG_DIVISORS:
        long = lengths >= (capacity // divisor if divisor else 0)
        order = np.argsort(np.where(long, -lengths, 0), kind="stable")
        bins, offsets = place(lengths[order], capacity)
        if best is None or bins.max() < best[1].max():
            best = order, bins, offsets
        if best[1].max() + 1 == least:
            break
    order, bins, offsets = best
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return bins[back], offsets[back]


def pack(table: DataFrame, capacity: int = CAPACITY, group: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces that is cheap to read twice."""
    from pyspark.sql.types import LongType, StructField, StructType

    small_batches(table.sparkSession)
    groups = max(1, round(table.count() / group))

    @lean(keep=True)
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        # A fixed order first, so that a task that runs again packs alike.
        held = held.sort_by([("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_place(held["length"].to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 40
        held = held.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        yield from held.combine_chunks().to_batches(max_chunksize=10_000)

    schema = StructType([*table.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    # Dealt round robin (Spark sorts before it deals, so a lost task is dealt alike), hence even groups whatever the ids.
    return table.repartition(groups).mapInArrow(fill, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(materialize(pieces(docs), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of what is left goes."""
    return pack(materialize(pieces(docs), "pieces"))
