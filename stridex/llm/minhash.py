"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

(1) Each document becomes a set of word shingles, of which ``BANDS * ROWS`` minima are taken; bands
of minima are hashed whole, and of each minimum two bits are kept, after a mix, and packed.  Documents
with one set form a class, and its smallest doc_id goes on alone, so exact copies cost one row each.
(2) Classes that share a band bucket are candidates.  Rather than all pairs of a bucket, each member
is paired with the bucket's smallest id; a count of equal low bits, corrected for chance collisions,
drops pairs five deviations below the threshold; the rest are confirmed on their full sets.
(3) Components follow.  Only members of one bucket that are still in different components are compared
further: they get a finer sketch, whose bits are counted pair by pair inside tasks, in blocks of a
bounded number of members; short sets go along whole and are compared exactly.  Of the pairs that pass, each member's closest is confirmed, again and
again while most of them prove linked, and then all that are still apart.  So every link between bucket mates
counts, nothing is compared within a component, and pairs that are not close become no rows.

A link of similarity exactly 0.8 shares no band with odds of 3e-6, of 0.85 with 2e-9.
Shingles are told apart by 64-bit hashes.  Defined cases: a null or wordless text has an empty set
and is linked with nothing; fewer words than a shingle make one shingle; rows that repeat a doc_id
are one document: their sets are linked, whatever the texts, though n_shingles is each row's own; a
wordless row of such an id stands for itself; a null doc_id is linked with nothing, has a null
component and is kept; a similarity of exactly the threshold is a link; an empty table gives no rows;
a very long text is read whole, at some 60 bytes a word; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.common import MIX, WordHash, discard, grams, groups_of, lean, materialize, mixed, release_shuffles, small_batches
from stridex.llm.graphs import components

ROWS, BANDS, BITS = 6, 42, 2
HASHES = ROWS * BANDS
THRESHOLD = 80  # per cent
#: Estimates this far below the threshold are dropped: five standard deviations at 0.8.
SLACK = 0.15
#: The finer sketch of the few that need it, and four and a half standard deviations of its estimate.
FINE, FINE_SLACK = 2048, 0.047
#: Pairs of sets of at most so many shingles are compared whole rather than by the finer sketch.
SHORT = 128
#: Members of a bucket that one task compares with as many others.
BLOCK = 2000
#: Members of one centre that a task confirms in a row; more are spread with a copy of the centre's set.
RUN = 500
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, (FINE, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, (FINE, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: bytes | None, size: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text with A-Z lower-cased."""
    h = hashes.array((text or b"").lower().split())
    if not len(h):
        return h
    return np.unique(grams(h, min(size, len(h))))


def minima(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    low = mixed(shingles).astype(np.uint32)
    out = np.full(hashes, np.iinfo(np.uint32).max, np.uint32)
    step = 512 * HASHES // hashes
    for k in range(0, len(low), step):
        np.minimum(out, (((low[k : k + step] ^ _XOR[:hashes]) * _MUL[:hashes])).min(1), out)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in m.reshape(BANDS, ROWS).T:
        keys = keys * MIX + column
    return mixed(keys)


def packed(m: np.ndarray) -> np.ndarray:
    low = np.zeros(-(-len(m) // 32) * 32, np.uint64)
    # Low bits of a minimum rest on the low bits of its shingle alone, under every function; mixed ones do not.
    low[: len(m)] = mixed(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    return (low.reshape(-1, 32) << (BITS * np.arange(32, dtype=np.uint64))).sum(1, dtype=np.uint64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key, low (packed bits) and bands; the last three null for an empty set."""
    small_batches(docs.sparkSession)

    @lean
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            n, keys, low, all_bands = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, size, hashes)
                n.append(len(s))
                m = minima(s) if len(s) else None
                keys.append(digest(s) if len(s) else None)
                low.append(None if m is None else packed(m).view(np.int64))
                all_bands.append(None if m is None else bands(m).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "set_key": pa.array(keys, pa.binary()), "low": pa.array(low, longs), "bands": pa.array(all_bands, longs)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, n_shingles long, set_key binary, low array<long>, bands array<long>")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from packed bits: the share of equal values, less what chance makes equal."""
    differ = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    pairs = F.transform(differ, lambda d: F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555))))
    equal = 1 - F.aggregate(pairs, F.lit(0), lambda a, n: a + n) / F.lit(float(HASHES))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """id, s: the full sets of the documents in ``wanted`` (doc_id, set_key, id), written down."""
    small_batches(docs.sparkSession)

    @lean
    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets = [shingle_set(t, size, hashes) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            # Of an id with several texts, the one that is meant.
            meant = [digest(s) == k for s, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "s": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(pa.array(meant))

    # A shuffled join at any size, as the ids grow with the documents.
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("shuffle_hash"), "doc_id").select("id", "set_key", "text")
    return materialize(rows.mapInArrow(to_sets, "id long, s binary"), "sets")


def nodes_of(sketches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with a set, and their node; and, if there are any, ties (id, node) of ids that have several sets.

    A node is the id itself, but for further sets of an id: those get numbers from the top of the
    64-bit range down, tied to the id, so the smallest node of a component is always an id.
    """
    usable = sketches.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    split = usable.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first < last").select("doc_id", "first")
    split = materialize(split, "split")
    if split.isEmpty():
        return usable.withColumn("node", F.col("doc_id")), None
    further = usable.select("doc_id", "set_key").distinct().join(split, "doc_id").where("set_key > first").select("doc_id", "set_key")
    ties = materialize(further.withColumn("other", F.lit((1 << 63) - 1) - F.monotonically_increasing_id()), "ties")
    met = usable.join(ties.withColumnRenamed("doc_id", "d").withColumnRenamed("set_key", "k"), (F.col("doc_id") == F.col("d")) & (F.col("set_key") == F.col("k")), "left")
    return met.withColumn("node", F.coalesce("other", "doc_id")).drop("d", "k", "other"), ties.select(F.col("doc_id").alias("a"), F.col("other").alias("b"))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked for each pair a < b, decided on full sets.  A centre's set travels once for a run of its members."""

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in batches:
            out = []
            for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s")), strict=True):
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    centre, held = a, s
                elif a == centre:
                    at = np.minimum(np.searchsorted(held, s), len(held) - 1)
                    both = int((held[at] == s).sum())
                    out.append((a, b, 100 * both >= THRESHOLD * (len(held) + len(s) - both)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b", "linked"])

    runs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    lead = runs.join(sets, runs.a == sets.id).select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), "s")
    dealt = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs").cast("long")).cast("int").alias("run"))
    follow = dealt.join(sets, dealt.b == sets.id).select("a", "b", "run", "s")
    met = lead.unionByName(follow).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())
    return materialize(met.mapInArrow(compare, "a long, b long, linked boolean").distinct(), "confirmed")


def finer(sets: DataFrame) -> DataFrame:
    """rep, bits, n, s: the packed finer sketch of each set, its size, and the set itself where it is short."""

    @lean
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("s").to_pylist()
            bits = [packed(minima(np.frombuffer(s, np.uint64), FINE)).tobytes() for s in sets]
            short = [s if len(s) <= 8 * SHORT else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits, pa.binary()), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(short, pa.binary())], names=["rep", "bits", "n", "s"])

    return materialize(sets.mapInArrow(compute, "rep long, bits binary, n long, s binary").dropDuplicates(["rep"]), "fine")


def numbered(sets: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of shingle numbers for each set, filled up with a last number that no shingle has, and a flag, unset, for each number."""
    parts = [np.frombuffer(s or b"", np.uint64) for s in sets]
    sizes = np.array([len(x) for x in parts])
    known, at = np.unique(np.concatenate(parts), return_inverse=True)
    number = np.full((len(parts), sizes.max()), len(known), np.int32)
    number[np.arange(number.shape[1]) < sizes[:, None]] = at
    return number, np.zeros(len(known) + 1, bool)


def close_pairs(members: DataFrame, fine: DataFrame) -> DataFrame:
    """a, b, e for members (key, rep, comp) of one bucket and different components whose finer estimate comes near the threshold, or, of short sets, whose similarity reaches it.

    fine: rep, bits, n, s, bands.  A pair is compared in the first band that it shares and in no other.
    """
    least = THRESHOLD / 100 - FINE_SLACK
    odd = np.uint64(0x5555555555555555)

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            g = table["g"].to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            for at, end in zip(cuts, cuts[1:], strict=False):
                some = table.slice(at, end - at)
                key, rep, comp, part = (some[c].to_numpy() for c in ("key", "rep", "comp", "part"))
                keys = np.array(some["bands"].to_pylist())
                band = (keys == key[:, None]).argmax(1)
                across = len(np.unique(part)) > 1
                bits = np.frombuffer(b"".join(some["bits"].to_pylist()), np.uint64).reshape(len(rep), -1)
                n, short = some["n"].to_numpy(), some["n"].to_numpy() <= SHORT
                number, has = numbered(some["s"].to_pylist())
                out = []
                for k in range(len(rep) - 1):
                    rest = np.flatnonzero((comp[k + 1 :] != comp[k]) & ((part[k + 1 :] != part[k]) | (not across))) + k + 1
                    rest = rest[(key[rest] == key[k]) & ~(keys[rest, : band[k]] == keys[k, : band[k]]).any(1)]
                    if not len(rest):
                        continue
                    x = bits[rest] ^ bits[k]
                    equal = 1 - np.bitwise_count((x | (x >> np.uint64(1))) & odd).sum(1) / FINE
                    e = (equal - 2.0**-BITS) / (1 - 2.0**-BITS)
                    near = e >= least
                    whole = np.flatnonzero(short[rest] & short[k])
                    if len(whole):
                        has[number[k]], has[-1] = True, False
                        both = has[number[rest[whole]]].sum(1)
                        has[number[k]] = False
                        either = n[k] + n[rest[whole]] - both
                        e[whole], near[whole] = both / either, 100 * both >= THRESHOLD * either
                    out += [(min(rep[k], rep[j]), max(rep[k], rep[j]), e[i]) for i, j in enumerate(rest) if near[i]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b", "e"])

    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = members.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    # Each block of a bucket meets each other block in a task of its own.
    faced = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = faced.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "key", "rep", "comp", "part").join(fine, "rep")
    found = met.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "a long, b long, e double")
    return materialize(found.groupBy("a", "b").agg(F.max("e").alias("e")), "close")


def near_duplicates(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    sketches = materialize(sketch(docs, size), "sketches")
    usable, ties = nodes_of(sketches)
    classes = materialize(usable.groupBy("set_key").agg(F.min("node").alias("rep")), "classes")
    reps = usable.join(classes, (usable.set_key == classes.set_key) & (usable.node == classes.rep)).select("rep", "doc_id", usable.set_key, "low", "bands")
    # Rows that repeat a document are one.
    reps = materialize(reps.dropDuplicates(["rep"]), "reps")
    postings = reps.select("rep", F.explode("bands").alias("key"))
    centres = postings.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").drop("last")
    # Only buckets that two classes share, with the smallest id of each.
    shared = materialize(postings.join(centres, "key"), "shared")
    release_shuffles(spark)
    low = reps.select("rep", "low")

    def estimated(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(low.select(F.col("rep").alias("a"), F.col("low").alias("low_a")), "a")
        with_b = with_a.join(low.select(F.col("rep").alias("b"), F.col("low").alias("low_b")), "b")
        return with_b.select("a", "b", estimate(F.col("low_a"), F.col("low_b")).alias("e")).where(F.col("e") >= THRESHOLD / 100 - SLACK)

    def best(pairs: DataFrame, by: str, partners: int) -> DataFrame:
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("e"), "a", "b"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= partners).select("a", "b")

    stars = shared.where("rep > centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    sets = sets_of(docs, reps.join(shared.select("rep").distinct(), "rep", "left_semi").select("doc_id", "set_key", F.col("rep").alias("id")), size)
    release_shuffles(spark)
    checked = confirm(materialize(best(estimated(stars), "b", 1), "stars"), sets)
    linked = checked.where("linked").select("a", "b")
    if ties is not None:
        # An id's sets are one document: its classes are linked, whatever their texts.
        reps_of = lambda end, name: usable.select(F.col("node").alias(end), "set_key").distinct().join(classes, "set_key").select(end, F.col("rep").alias(name))
        other = ties.join(reps_of("a", "x"), "a").join(reps_of("b", "y"), "b")
        linked = linked.unionByName(other.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    comp = components(linked)
    named = shared.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    several = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    # Only buckets with members of several components.
    members = materialize(named.join(several, "key", "left_semi"), "open")
    some = members.select(F.col("rep").alias("id")).distinct()
    fine = finer(sets.join(some, "id", "left_semi")).join(reps.select("rep", "bands"), "rep")
    # Some were refuted as stars; confirming those few again is less than finding them here.
    left = close_pairs(members, fine)
    discard(members)
    release_shuffles(spark)
    of = lambda end: comp.select(F.col("id").alias(end), F.col("comp").alias(f"c_{end}"))
    closest_only = True
    while not left.isEmpty():
        tried = materialize(best(left, "b", 1), "tried") if closest_only else left.select("a", "b")
        more = confirm(tried, sets)
        joined = more.where("linked")
        n_joined = joined.count()
        if n_joined:
            lifted = joined.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
            merged = components(lifted).select(F.col("id").alias("old"), F.col("comp").alias("new"))
            known = comp.unionByName(merged.select(F.col("old").alias("id"), F.col("old").alias("comp")).join(comp, "id", "left_anti"))
            comp = materialize(known.join(merged, known.comp == merged.old, "left").select("id", F.coalesce("new", "comp").alias("comp")), "components")
        if not closest_only:
            break
        # Pairs that have come into one component meanwhile need no confirming.
        rest = left.join(tried, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        apart = rest.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b", "e")
        closest_only = 2 * n_joined >= tried.count()
        left = materialize(apart, "left")
    discard(sets)
    placed = sketches.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    placed = placed.join(comp, placed.rep == comp.id, "left")
    id_type = docs.schema["doc_id"].dataType
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "rep", "doc_id"))
    return placed.select(F.col("doc_id").cast(id_type), "n_shingles", found.cast(id_type).alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2)


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM docs
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM docs
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

STAGE_SHINGLE = 5


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that a smaller id of their group stands for.

    Cases are as above: wordless documents and null ids stay, all rows of an id stay or go together,
    and all columns pass through.
    """
    dropped = near_duplicates(docs, STAGE_SHINGLE).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
