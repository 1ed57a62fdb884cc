"""Substring deduplication with prefix-partitioned, sparse suffix trees over words.

A window is ``window`` consecutive words of one document; each word that a window covers whose word
sequence starts earlier (smaller doc_id, or the same document and an earlier start) is removed.

The suffixes kept are those at anchors: in each window, the leftmost least hash of ``PREFIX`` words.
Equal windows have equal anchors at equal offsets, so a window's twins all meet in its anchor's
group.  Suffixes are split into groups by prefixes of variable length:

(1) A corpus-wide count of anchors (see ``blocks``) drops every prefix that occurs once.
(2) Each block sends, per remaining anchor, the words after and before it, one row for equal
    surroundings however often the block has them.
(3) A prefix whose group would exceed ``GROUP_ROWS`` rows grows by ``GROW`` words at a time: its rows
    become one a window, and the words that follow the anchor in that window, then those before it,
    join the prefix until each group fits.  A group whose prefix is the whole window is one node of
    the tree; it is read row by row, as only its earliest occurrence has to be remembered.
(4) A task builds the subtrees of its groups one after another: it sorts the suffixes below the
    prefix, and, reversed, what stands before them, and numbers the inner nodes at each depth.  A
    node below the prefix and one of what stands before it, whose depths and the prefix add up to
    the window, are together the node of a window; it is internal, hence a repeat, if two leaves
    share it.  In each, all leaves but the earliest are marked.
(5) Marks go back to the blocks, where marked windows that overlap or touch run together to
    repeated passages that can be extended to neither side (``passages``).

Prefixes compare by 64-bit hash, surrounding words by 32 bits each on top of it.  Defined cases: a
null text has no words; documents shorter than the window lose nothing; rows that repeat a document
(same id and text) are one document and get the same result; rows that share an id but not the text
count as parts of one document, in the order of their texts' hashes; a null doc_id sorts last; an
empty table gives no rows; a very long text is a block of its own, held whole by one task at some
100 bytes a word; other columns pass through ``remove`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.blocks import SENT, Blocks, answered, in_blocks, sent, totals
from stridex.llm.common import MIX, WordHash, grams, groups_of, lean, materialize, mixed, release_shuffles

WINDOW = 20
PREFIX = 8
#: Rows of a group, some 500 bytes each while its subtree is built.  A prefix with more grows.
GROUP_ROWS = 200_000
#: Words by which a prefix grows at a time.
GROW = 4
NO_ID = np.iinfo(np.int64).max
SUFFIX = "part long, anchor long, block long, row int, doc long, version long, at int, low int, high int, words binary, whole boolean, hot boolean"
MARKS = "block long, row int, at int, marks long"
_I, _L = pa.int32(), pa.int64()
_SUFFIX = pa.schema([("part", _L), ("anchor", _L), ("block", _L), ("row", _I), ("doc", _L), ("version", _L), ("at", _I), ("low", _I), ("high", _I), ("words", pa.binary()), ("whole", pa.bool_()), ("hot", pa.bool_())])


def anchors(hashes: np.ndarray, window: int, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows that share an anchor: the anchor's position and hash, first and last window start."""
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, np.empty(0, np.uint64), none, none
    g, span = grams(hashes, prefix), window - prefix + 1
    value, place, width = g, np.arange(len(g)), 1
    while width < span:
        # Two shorter ranges give the next; the left one wins ties, so the leftmost least stays.
        shift = min(width, span - width)
        later = value[shift:] < value[: len(value) - shift]
        place = np.where(later, place[shift:], place[: len(place) - shift])
        value = np.where(later, value[shift:], value[: len(value) - shift])
        width += shift
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], len(place)] - 1
    return place[first], g[place[first]], first, last


def documents_of(table: pa.Table) -> tuple[list[tuple[int, int, bytes]], np.ndarray]:
    """A block's distinct (id, hash of the text, text) in order, and which of them each row is."""
    ids = [NO_ID if x is None else x for x in table["doc_id"].to_pylist()]
    texts = [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]
    keys = [(i, xxhash.xxh3_64_intdigest(t) >> 1, t) for i, t in zip(ids, texts, strict=True)]
    rows = sorted(set(keys))
    index = {r: k for k, r in enumerate(rows)}
    return rows, np.array([index[r] for r in keys], np.int64)


def node_ids(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Tree nodes by depth: out[d, i] is the number of the node that row i reaches after d words below its group's root."""
    depth = words.shape[1]
    order = np.lexsort((*words.T[::-1], group))
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    out = np.empty((depth + 1, len(group)), np.int64)
    for d in range(depth + 1):
        if d:
            new |= np.r_[True, words[order, d - 1][1:] != words[order, d - 1][:-1]]
        out[d, order] = np.cumsum(new) - 1
    return out


def repeats(group, doc, version, at, low, high, before, after) -> np.ndarray:
    """A bit for each offset of the anchor in a window: set where the window occurs earlier."""
    order = np.lexsort((at, version, doc))
    # Rows of one document that came twice stand at one place and are both its first occurrence.
    place = np.cumsum(np.r_[False, (np.diff(doc[order]) != 0) | (np.diff(version[order]) != 0) | (np.diff(at[order]) != 0)])
    left, right = node_ids(group[order], before[order]), node_ids(group[order], after[order])
    span, marks = before.shape[1], np.zeros(len(group), np.int64)
    for offset in range(span + 1):
        has = np.flatnonzero((low[order] <= offset) & (offset <= high[order]))
        if not len(has):
            continue
        node = left[offset, has] * np.int64(len(group)) + right[span - offset, has]
        # A stable sort leaves the earliest occurrence in front.
        by = np.argsort(node, kind="stable")
        head = np.r_[True, node[by][1:] != node[by][:-1]]
        first = place[has[by]][np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]
        marks[order[has[by[place[has[by]] != first]]]] |= np.int64(1) << np.int64(offset)
    return marks


def grown(key: np.ndarray, words: np.ndarray, offset: int, size: int) -> np.ndarray:
    """Hashes of anchors with the first ``size`` words of a window's rest: those after the anchor, then those before it.  words: the nearest before, then after."""
    span = words.shape[1] // 2
    rest = [*range(span, 2 * span - offset), *range(offset)]
    h = mixed(key + np.uint64(offset + 1))
    for w in rest[:size]:
        h = h * MIX + words[:, w].astype(np.uint64)
    return mixed(h)


def _marked(batch: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("block", "row", "at")} | {"marks": pa.array(marks)})


def mark_windows(blocks: Blocks, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """block, row (of ``documents_of``), at (anchor position), marks: windows that occur earlier.  blocks: of doc_id, text."""
    spark, span = blocks.table.sparkSession, window - prefix
    if not 0 <= span <= 62:
        raise ValueError("the window may exceed the prefix by 62 words at most")
    shards, group_rows, grow = blocks.shards, GROUP_ROWS, GROW

    def send(block: int, rows: pa.Table) -> pa.Table:
        hashes, parts = WordHash(), [np.empty(0, np.uint64)]
        for _, _, text in documents_of(rows)[0]:
            parts.append(anchors(hashes.array(text.split()), window, prefix)[1])
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        return sent(block, 0, keys, counts, shards)

    answers = materialize(totals(blocks.each(send, SENT)), "anchors")
    release_shuffles(spark)

    def surround(block: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        hashes, found = WordHash(), []
        for k, (doc, version, text) in enumerate(documents_of(rows)[0]):
            h = hashes.array(text.split())
            place, key, first, last = anchors(h, window, prefix)
            if len(place):
                found.append((k, doc, version, h, place, key, first, last))
        if not found:
            return _SUFFIX.empty_table()
        keys = np.unique(np.concatenate([x[5] for x in found]))
        count = answered(got, 0)
        some, many = keys[count > 1], count[count > 1]
        out = [[] for _ in range(9)]
        for k, doc, version, h, place, key, first, last in found:
            where = np.minimum(np.searchsorted(some, key), max(len(some) - 1, 0))
            use = np.flatnonzero(some[where] == key) if len(some) else []
            if not len(use):
                continue
            place, key, first, last = place[use], key[use], first[use], last[use]
            short = np.concatenate([np.zeros(span, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(span, np.uint32)])
            step = np.arange(span)
            low, high = place - last, place - first
            # Words that none of the run's windows reach are blanked, so equal runs have equal rows.
            before = np.where(step < high[:, None], short[place[:, None] + span - 1 - step], 0).astype(np.uint32)
            after = np.where(step < span - low[:, None], short[place[:, None] + span + prefix + step], 0).astype(np.uint32)
            n = len(place)
            for column, values in zip(out, (key, np.full(n, k), np.full(n, doc), np.full(n, version), place, low, high, np.hstack([before, after]), many[where[use]]), strict=True):
                column.append(values)
        if not out[0]:
            return _SUFFIX.empty_table()
        key, row, doc, version, at, low, high, words, total = (np.concatenate(x) for x in out)
        # Equal surroundings within the block: the first stands for all, the others are known repeats.
        packed = np.hstack([key.view(np.uint32).reshape(-1, 2), low[:, None].astype(np.uint32), high[:, None].astype(np.uint32), words])
        whole = np.ascontiguousarray(packed).view(f"V{4 * packed.shape[1]}").ravel()
        lead = np.zeros(len(key), bool)
        lead[np.unique(whole, return_index=True)[1]] = True
        blobs = np.ascontiguousarray(words)
        part = np.where(lead, key, mixed(np.arange(len(key), dtype=np.uint64))).view(np.int64)

        def table_of(rows, part, low, high, hot) -> pa.Table:
            text = pa.array([blobs[r].tobytes() if lead[r] else None for r in rows], pa.binary())
            flags = [pa.array(np.full(len(rows), x)) for x in (False, hot)]
            return pa.Table.from_arrays([pa.array(part), pa.array(key[rows].view(np.int64)), pa.array(np.full(len(rows), block, np.int64)), pa.array(row[rows].astype(np.int32)), pa.array(doc[rows]), pa.array(version[rows]), *(pa.array(x.astype(np.int32)) for x in (at[rows], low, high)), text, *flags], schema=_SUFFIX)

        plain = np.flatnonzero(~lead | (total <= group_rows))
        tables = [table_of(plain, part[plain], low[plain], high[plain], False)]
        hot = np.flatnonzero(lead & (total > group_rows))
        for offset in range(span + 1 if len(hot) else 0):
            rows_at = hot[(low[hot] <= offset) & (offset <= high[hot])]
            at_offset = np.full(len(rows_at), offset)
            tables.append(table_of(rows_at, grown(key[rows_at], words[rows_at], offset, 0).view(np.int64), at_offset, at_offset, True))
        return pa.concat_tables(tables)

    def longer(size: int, whole: bool):
        @lean
        def grow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.uint32).reshape(batch.num_rows, 2 * span)
                key, offset, part = batch.column("anchor").to_numpy().view(np.uint64), batch.column("low").to_numpy(), np.empty(batch.num_rows, np.uint64)
                for o in np.unique(offset):
                    mine = offset == o
                    part[mine] = grown(key[mine], words[mine], int(o), size)
                columns = {c: batch.column(c) for c in _SUFFIX.names} | {"part": pa.array(part.view(np.int64)), "whole": pa.array(np.full(batch.num_rows, whole))}
                yield pa.RecordBatch.from_pydict(columns, schema=_SUFFIX)

        return grow_rows

    @lean
    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "part"):
            known = pa.compute.is_null(table["words"])
            for batch in table.filter(known).to_batches():
                low, high = batch.column("low").to_numpy().astype(np.int64), batch.column("high").to_numpy().astype(np.int64)
                yield _marked(batch, ((np.int64(1) << (high - low + 1)) - 1) << low)
            table = table.filter(pa.compute.invert(known)).combine_chunks()
            if not table.num_rows:
                continue
            words = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint32).reshape(table.num_rows, 2 * span)
            column = lambda c: table[c].to_numpy().astype(np.int64)  # noqa: B023, E731
            # Groups of one prefix with another length can't meet: the prefix decides the group, the anchor the tree's root.
            group = np.unique(np.stack([column("part"), column("anchor")]), axis=1, return_inverse=True)[1].ravel()
            marks = repeats(group, column("doc"), column("version"), column("at"), column("low"), column("high"), words[:, :span], words[:, span:])
            for batch in table.append_column("marks", pa.array(marks)).filter(pa.array(marks != 0)).to_batches():
                yield _marked(batch, batch.column("marks").to_numpy())

    @lean
    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of groups that are one node, the earliest first: all others are marked, and no group is held."""
        node = first = None
        for batch in batches:
            part, place = batch.column("part").to_numpy(), np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "version", "at")], 1)
            later = np.zeros(len(part), bool)
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if part[a] != node:
                    node, first = part[a], place[a].copy()
                later[a:b] = (place[a:b] != first).any(1)
            if later.any():
                some = batch.filter(pa.array(later))
                yield _marked(some, np.int64(1) << some.column("low").to_numpy().astype(np.int64))

    rows = blocks.told(answers, surround, SUFFIX)
    most = answers.agg(F.max("most")).first()[0] or 0
    nodes = None
    if most > group_rows:
        rows = materialize(rows, "suffixes")
        groups, left, size = [rows.where("NOT hot")], rows.where("hot"), 0
        while True:
            sizes = left.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("part")
            large = materialize(sizes, "large")
            groups.append(left.join(large, "part", "left_anti").select(*_SUFFIX.names))
            size = min(size + grow, span)
            left = materialize(left.join(large, "part", "left_semi").select(*_SUFFIX.names).mapInArrow(longer(size, size == span), SUFFIX), "longer")
            if size == span or left.isEmpty():
                break
        rows, nodes = groups[0], left
        for more in groups[1:]:
            rows = rows.unionByName(more)
    # Tasks in proportion to the text; each goes through its groups one after another.
    marks = rows.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(subtree, MARKS)
    if nodes is None:
        return marks
    return marks.unionByName(nodes.repartition(shards, "part").sortWithinPartitions("part", "doc", "version", "at").mapInArrow(earliest, MARKS))


def covered(n: int, at: np.ndarray, marks: np.ndarray, window: int) -> np.ndarray:
    """True for each of n words that a marked window covers."""
    steps = np.zeros(n + 1, np.int64)
    for offset in range(int(marks.max(initial=0)).bit_length()):
        start = at[(marks >> np.int64(offset)) & 1 == 1] - offset
        np.add.at(steps, start, 1)
        np.add.at(steps, start + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _per_document(docs: DataFrame, window: int, prefix: int, body, schema: str) -> DataFrame:
    """Runs body(results, rows) for each block: a result is a text, its words and which of them go."""
    blocks = in_blocks(docs, "passage-blocks")
    marked = materialize(mark_windows(blocks, window, prefix), "marks")
    release_shuffles(docs.sparkSession)

    def finish(_: int, rows: pa.Table, marks: pa.Table) -> pa.Table:
        docs, index = documents_of(rows)
        marks = marks.sort_by("row")
        row, at, bits = (marks[c].to_numpy() for c in ("row", "at", "marks"))
        cuts = np.searchsorted(row, np.arange(len(docs) + 1))
        results = []
        for k, (_, _, text) in enumerate(docs):
            words = text.split()
            s = slice(cuts[k], cuts[k + 1])
            results.append((text, words, covered(len(words), at[s].astype(np.int64), bits[s], window)))
        return body([results[k] for k in index], rows)

    return blocks.told(marked, finish, schema)


def digest(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    id_type = docs.schema["doc_id"].dataType

    def body(results, rows: pa.Table) -> pa.Table:
        kept = [b" ".join(w for w, g in zip(words, gone, strict=True) if not g) if gone.any() else b" ".join(words) for _, words, gone in results]
        return pa.table(
            {
                "doc_id": rows["doc_id"],
                "n_words": pa.array([len(x[1]) for x in results], pa.int64()),
                "n_removed": pa.array([int(x[2].sum()) for x in results], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
            }
        )

    return _per_document(docs.select("doc_id", "text"), window, prefix, body, f"doc_id {id_type.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def passages(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """doc_id, start, length (in words) of each passage that repeats and occurs earlier, as far as it reaches to both sides."""
    id_type = docs.schema["doc_id"].dataType

    def body(results, rows: pa.Table) -> pa.Table:
        at, start, length = [], [], []
        for k, (_, _, gone) in enumerate(results):
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            at += [k] * (len(edges) // 2)
            start += edges[::2].tolist()
            length += (edges[1::2] - edges[::2]).tolist()
        return pa.table({"doc_id": rows["doc_id"].take(pa.array(at, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64())})

    return _per_document(docs.select("doc_id", "text"), window, prefix, body, f"doc_id {id_type.simpleString()}, start long, length long")


def without_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words and the space after each."""
    out, last = [], 0
    for k, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)):
        if gone[k]:
            out.append(text[last : m.start()])
            last = m.end()
    return b"".join([*out, text[last:]])


def remove(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a null text stays null.  ``drop_emptied`` drops documents that lose every word."""

    def body(results, rows: pa.Table) -> pa.Table:
        old = rows["text"].to_pylist()
        new = [t if not r[2].any() else without_words(r[0], r[2]).decode() for t, r in zip(old, results, strict=True)]
        at = rows.schema.get_field_index("text")
        out = rows.set_column(at, "text", pa.array(new, rows.schema.field("text").type))
        return out.filter(pa.array([not len(r[2]) or not r[2].all() for r in results])) if drop_emptied else out

    return _per_document(docs, window, prefix, body, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), gone AS (
  SELECT doc_id, count(DISTINCT k) AS n, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM later) GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM docs
), cut AS (
  SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(ks) AS k FROM gone)
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS t FROM words ANTI JOIN cut USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The pipeline cuts passages of this many words; shorter ones recur in honest text.
STAGE_WINDOW = 50


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one that loses every word goes.  ``n_chars`` follows the text.

    Cases are as above: a null or wordless text stays as it is, repeated rows get the same result,
    and columns of any other name pass through.
    """
    left = remove(docs, STAGE_WINDOW, drop_emptied=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
