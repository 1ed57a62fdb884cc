"""Language identification by prediction by partial matching over bytes.

Training counts, per language, every byte in its context of three bytes, over all training texts;
shorter contexts follow by summing.  The model is a variable-order context tree of all entries, and
what is not in the tree is reached by escapes (method C, without exclusion).  A text's code length is
the exact sum over its bytes under each language's frozen tree; the shortest wins, ties to the
smaller name.  ``score`` is the winner's posterior under equal priors.

The query broadcasts orders 0 and 1 only, at most 65,536 entries a language.  Orders 2 and 3 are dealt
into shards by the last two bytes of their context, so a shard holds all that a code's longer
contexts need; blocks of documents ask the shards for the bits of their distinct codes.  ``train``
gives the same model in one piece, for training texts that are few.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, as is any text when
nothing was learned; null languages are not learned; repeated rows count and score each; equal code
lengths go to the smaller name; an empty table gives no rows; a very long text is read in parts of
``CHUNK`` bytes, each with the three bytes before it, so its counts and bits are those of the whole;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.blocks import in_blocks
from stridex.llm.common import fold, held_out, materialize, small_batches

ORDER = 3
FOLDS = 5
UNKNOWN = "und"
CHUNK = 1_000_000
#: Text in a block: large ones have fewer distinct codes for their size; a task holds some ten bytes for each of theirs.
BLOCK_BYTES = 32_000_000
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b"\0" * ORDER


def codes(texts: list[bytes], before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the three before it as one 32-bit number, and where each text starts with what is before it; what is before has a low byte of 0."""
    before = before or [_PAD] * len(texts)
    data = np.frombuffer(b"".join(part for b, t in zip(before, texts, strict=True) for part in (b, t.replace(b"\0", b"\1"))), np.uint8).astype(np.uint32)
    out = data.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= data[:-k] << np.uint32(8 * k)
    starts = np.cumsum([0, *(len(t) + ORDER for t in texts)])[:-1]
    for k in range(ORDER):
        out[starts + k] = 0
    return out, starts


def chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """Texts, longer ones in parts, in runs of CHUNK to twice as many bytes: the number of each part's text, the part, and the bytes before it."""
    owner, parts, before, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t), 1), CHUNK):
            owner.append(k), parts.append(t[at : at + CHUNK]), before.append(t[at - ORDER : at].replace(b"\0", b"\1") if at else _PAD)
            size += len(parts[-1])
            if size >= CHUNK:
                yield owner, parts, before
                owner, parts, before, size = [], [], [], 0
    if owner:
        yield owner, parts, before


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64)


def count_contexts(docs: DataFrame) -> DataFrame:
    """lang, code, n over all rows of ``docs`` (text, lang), summed within tasks and then by key."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, *some in chunks(texts):
                    c = codes(*some)[0]
                    held.setdefault(lang, []).append(np.unique(c[(c & np.uint32(255)) != 0], return_counts=True))
                parts = held[lang]
                if len(parts) > 8:
                    held[lang] = [_summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
        for lang, parts in held.items():
            keys, n = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            for k in range(0, len(keys), 100_000):
                some = keys[k : k + 100_000]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "code": pa.array(some.astype(np.int64)), "n": pa.array(n[k : k + 100_000])})

    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


class Tree:
    """One language's context tree: for each order the sorted entries and contexts with their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None):
        """``low``: entries of order 1 with their counts, where ``keys`` are a shard's only."""
        self.orders = []
        for order in range(ORDER + 1):
            of, many = low if low is not None and order < 2 else (keys, counts)
            entry, n = _summed(of & np.uint32((1 << (8 * (order + 1))) - 1), many)
            context, total = _summed(entry >> np.uint32(8), n)
            kinds = _summed(entry >> np.uint32(8), np.ones(len(entry)))[1]
            self.orders.append((entry, n, context, total, kinds))

    def log2(self, code: np.ndarray) -> np.ndarray:
        """log2 of the probability of each byte after its context: escapes lead from the longest context seen to shorter ones."""
        p = np.full(len(code), 1 / 256)
        for order, (entry, n, context, total, kinds) in enumerate(self.orders):
            if not len(entry):
                continue
            key = code & np.uint32((1 << (8 * (order + 1))) - 1)
            at, there = _find(context, key >> np.uint32(8))
            hit, known = _find(entry, key)
            mass = total[at] + kinds[at]
            p = np.where(known, n[hit] / mass, np.where(there, kinds[at] / mass * p, p))
        return np.log2(p)


def _find(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


class Model:
    """All trees, and the bits of every entry of any tree under each language (a last row of zeros stands for pads)."""

    def __init__(self, entries: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(entries)
        self.trees = [Tree(*entries[x]) for x in self.langs]
        self.keys = np.unique(np.concatenate([entries[x][0] for x in self.langs])) if entries else np.empty(0, np.uint32)
        self.bits = np.vstack([np.stack([t.log2(self.keys) for t in self.trees], 1), np.zeros((1, len(self.langs)))]).astype(np.float32) if entries else None

    @classmethod
    def of_codes(cls, langs: list[str], keys: np.ndarray, bits: np.ndarray) -> Model:
        """A model that knows the bits of some sorted codes only."""
        model = cls({})
        model.langs, model.keys, model.bits = langs, keys, np.vstack([bits, np.zeros((1, len(langs)), np.float32)])
        return model

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """log2 probability of each whole text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for owner, *some in chunks(texts):
            c, starts = codes(*some)
            at, hit = _find(self.keys, c)
            pads = (c & np.uint32(255)) == 0
            at[pads] = len(self.keys)
            bits = self.bits[at]
            new = np.flatnonzero(~hit & ~pads)
            if len(new):
                bits[new] = np.stack([t.log2(c[new]) for t in self.trees], 1)
            np.add.at(out, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
        return out


def train(docs: DataFrame, max_entries: int | None = None) -> Model:
    """A model from the rows of ``docs`` (text, lang), of all entries unless the caller bounds them: then the rarest go."""
    table = materialize(count_contexts(docs), "contexts")
    least = 1
    while max_entries is not None and table.where(F.col("n") >= least).count() > max_entries:
        least *= 2
    return Model(by_language(table.where(F.col("n") >= least).toPandas()))


def by_language(rows: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted codes and their counts for each language of rows (lang, code, n)."""
    entries = {}
    for lang, part in rows.groupby("lang"):
        order = np.argsort(part["code"].to_numpy())
        entries[lang] = part["code"].to_numpy()[order].astype(np.uint32), part["n"].to_numpy()[order].astype(np.int64)
    return entries


def predicted(m: Model, batch: pa.RecordBatch | pa.Table) -> dict[str, pa.Array]:
    column = batch.column("text")
    lang, score = [UNKNOWN] * len(column), np.zeros(len(column))
    rows = [k for k, t in enumerate(column.to_pylist()) if t is not None and _LETTER.search(t)]
    if rows and m.langs:
        totals = m.totals(column.cast(pa.binary()).take(pa.array(rows)).to_pylist())
        best = totals.argmax(1)
        odds = 1 / np.exp2(np.maximum(totals - totals.max(1, keepdims=True), -1000)).sum(1)
        for k, b in zip(rows, best, strict=True):
            lang[k] = m.langs[b]
        score[rows] = odds
    return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)}


def flagged(docs: DataFrame) -> tuple[DataFrame, str]:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out("doc_id", FOLDS, 0).alias("held_out"), F.col("text").cast("string")), f"doc_id {id_type}, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(predicted(shared.value, batch))

    rows, schema = flagged(docs)
    return rows.mapInArrow(predict, schema)


def learn_and_identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """As ``identify`` with a model of ``training`` that is in one piece nowhere."""
    spark = docs.sparkSession
    table = materialize(count_contexts(training), "contexts")
    low = by_language(table.groupBy("lang", F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("code")).agg(F.sum("n").alias("n")).toPandas())
    if not low:
        return identify(docs, Model({}))
    langs = sorted(low)
    shared = spark.sparkContext.broadcast(low)
    rows, schema = flagged(docs)
    blocks = in_blocks(rows, "language-blocks", BLOCK_BYTES)
    shards = blocks.shards

    def send(block: int, some: pa.Table) -> pa.Table:
        texts = some["text"].cast(pa.binary()).drop_null().to_pylist()
        parts = [np.unique(c[(c & np.uint32(255)) != 0]) for c in (codes(*some)[0] for _, *some in chunks(texts))]
        keys = np.unique(np.concatenate([np.empty(0, np.uint32), *parts]))
        # The last two bytes of the context, scrambled; as in ``owned``.
        owner = (((keys >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64) * 40503) & 0xFFFF) % shards
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(keys) else np.zeros(1, np.int64)
        packets = [keys[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"block": pa.array([block] * len(packets), pa.int64()), "shard": pa.array(owner[cuts[:-1]], pa.int32()), "keys": pa.array(packets, pa.binary())})

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in asked["keys"].to_pylist()]
        if not parts:
            return pa.table({"block": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "bits": pa.array([], pa.binary())})
        wanted, back = np.unique(np.concatenate(parts), return_inverse=True)
        entries, none = by_language(own.to_pandas()), (np.empty(0, np.uint32), np.empty(0, np.int64))
        bits = np.stack([Tree(*entries.get(x, none), shared.value[x]).log2(wanted) for x in langs], 1).astype(np.float32)
        ends = np.cumsum([len(x) for x in parts])
        return pa.table({"block": asked["block"], "keys": asked["keys"], "bits": pa.array([bits[back[e - len(x) : e]].tobytes() for e, x in zip(ends, parts, strict=True)], pa.binary())})

    def predict(_: int, some: pa.Table, got: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(got["keys"].to_pylist()), np.uint32)
        bits = np.frombuffer(b"".join(got["bits"].to_pylist()), np.float32).reshape(-1, len(langs))
        order = np.argsort(keys)
        return pa.table(predicted(Model.of_codes(langs, keys[order], bits[order]), some.combine_chunks()))

    asked = blocks.each(send, "block long, shard int, keys binary")
    owned = table.withColumn("shard", (F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF)) * 40503).bitwiseAND(F.lit(0xFFFF)) % shards).withColumn("shard", F.col("shard").cast("int"))
    answers = asked.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(answer, "block long, keys binary, bits binary")
    return blocks.told(answers, predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return learn_and_identify(docs, docs.where(fold("doc_id", FOLDS) != 0))
