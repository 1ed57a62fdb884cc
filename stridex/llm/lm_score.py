"""Language-model scores by a weighted backoff automaton over words, of order three.

States are histories of no, one and two words; the beginning of a text is a word of its own there.
Every n-gram of the training texts is an arc from the state of its history: it carries the log
probability of its last word and leads to the longest history that is a state.  A word without an
arc takes the failure arc instead, to the state of the history less its first word, at the price of
the backoff weight; the empty history has an arc for every word.  A text is read once from left to
right, carrying the state; all texts of a block are read side by side, and a text longer than
``STRETCH`` tokens in stretches: as a state is decided by the last two words, a stretch reads the two
before it first and is then in the very state that a reader from the start would be in.

Smoothing: unigrams add one, with one class for all unknown words; a longer history mixes its counts
with the next shorter one, which has a mass of ``MASS`` observations (a Dirichlet estimate), so the
probabilities of all words after any history sum to one.

Counts cover all training documents.  No model is broadcast: each block of documents gets the part
of the automaton that its own words can reach, with exact corpus-wide counts (see ``blocks``).

Defined cases: a null or empty text holds the end token alone; repeated rows count and score each;
an empty table gives no rows; without training tokens all words are unknown; a null doc_id is
neither trained on nor held out; a very long text is a block of its own and is held whole by one
task, at some 300 bytes a token; nothing here rests on order, so there are no ties; other columns
are ignored.  Words are told apart by 64-bit hashes, pairs and triples by 56 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.blocks import SENT, answered, in_blocks, sent, totals
from stridex.llm.common import MIX, WordHash, fold, held_out, materialize, mixed, release_shuffles

FOLDS, HELD = 7, 2
#: Mass of the shorter history in one of one word, and of two; the best of those tried by the score of held-out texts at sf0.1.
MASS = (200.0, 5.0)
#: Tokens that are read in a row; more are read side by side.
STRETCH = 512
END, BEGIN = b" ", b"\n"  # no word can equal these
UNIGRAM, BIGRAM, TRIGRAM = 0, 1, 2
#: Text in a block: a task holds some 60 bytes for each byte of it.
BLOCK_BYTES = 6_000_000
#: Bits of the hash of a pair or triple that count; the rest need not be sent.
KEPT = np.uint64((1 << 64) - (1 << 8))


class Streams:
    """Texts as token hashes in a row, each closed by the end token, with the hashes of pairs and triples that end at each token."""

    def __init__(self, texts: list[bytes | None]):
        hashes, parts, sizes = WordHash(), [np.empty(0, np.uint64)], []
        for text in texts:
            words = (text or b"").lower().split()
            words.append(END)
            parts.append(hashes.array(words))
            sizes.append(len(words))
        self.tokens, self.sizes = np.concatenate(parts), np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = hashes[BEGIN]
        self.pairs = mixed(before * MIX + self.tokens) & KEPT
        #: Where a pair, the beginning among its words, comes before the token; the first token of a text has no triple.
        self.later = np.ones(len(self.tokens), bool)
        self.later[self.starts] = False
        self.later = np.flatnonzero(self.later).astype(np.int32)
        self.triples = mixed(self.pairs[self.later - 1] * MIX + self.tokens[self.later]) & KEPT


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key comes, in the order of the keys, and which of them each key is."""
    order = np.argsort(keys, kind="stable").astype(np.int32)
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], which


class Automaton:
    """The part of the automaton that the texts of a block reach.

    States: 0 is the empty history, then one for each distinct word, one for the beginning, and one
    for each distinct pair.  Arcs are kept sorted by state and word.
    """

    def __init__(self, s: Streams, counts: list[np.ndarray], types: int, n: int, mass: tuple[float, float]):
        first, self.word = numbered(s.tokens)
        pair_first, pair = numbered(s.pairs)
        triple_first, _ = numbered(s.triples)
        one, two, three = (c.astype(np.float64) for c in counts)
        v = len(first)
        self.width, self.begin, first_pair = v + 1, 1 + v, 2 + v
        self.count = one
        root = (one + 1) / (n + types + 1)
        self.root, self.after_root = np.log10(root), np.where(one > 0, 1 + np.arange(v), 0)
        # Every training text begins once, so the beginning counts as often as the end.
        end = self.word[s.starts[0] + s.sizes[0] - 1]
        history = np.r_[one, one[end]]
        # The word before the last one of each pair, or the beginning.
        before = np.empty(len(s.tokens), np.int32)
        before[1:] = self.word[:-1]
        before[s.starts] = v
        pair_before, pair_word = before[pair_first], self.word[pair_first]
        second = (two + mass[0] * root[pair_word]) / (history[pair_before] + mass[0])
        at = s.later[triple_first]
        triple_pair, triple_word = pair[at - 1], self.word[at]
        third = (three + mass[1] * second[pair[at]]) / (two[triple_pair] + mass[1])
        seen2, seen3 = two > 0, three > 0
        wide = lambda x: x.astype(np.int64)
        key = np.r_[(1 + wide(pair_before[seen2])) * self.width + pair_word[seen2], (first_pair + wide(triple_pair[seen3])) * self.width + triple_word[seen3]]
        log = np.log10(np.r_[second[seen2], third[seen3]])
        to = first_pair + np.r_[np.flatnonzero(seen2), pair[at][seen3]]
        order = np.argsort(key)
        self.key, self.log, self.to = key[order], log[order], to[order]
        # Failure arcs: a pair falls back to its last word, a word and the beginning to the empty history.
        self.fail = np.r_[np.zeros(2 + v, np.int64), 1 + pair_word]
        self.weight = np.log10(np.r_[1.0, mass[0] / (history + mass[0]), mass[1] / (two + mass[1])])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after reading a word in each state, and the log10 probabilities."""
        log, to = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], word[todo]
            at_root = s == 0
            if at_root.any():
                done = todo[at_root]
                log[done] += self.root[w[at_root]]
                to[done] = self.after_root[w[at_root]]
                todo, s, w = todo[~at_root], s[~at_root], w[~at_root]
            if not len(todo):
                break
            key = s * self.width + w
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
            done = todo[hit]
            log[done] += self.log[at[hit]]
            to[done] = self.to[at[hit]]
            todo, s = todo[~hit], s[~hit]
            log[todo] += self.weight[s]
            state[todo] = self.fail[s]
        return to, log

    def read(self, s: Streams, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each text."""
        parts = -(-s.sizes // stretch)
        text = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        ahead = np.where(number > 0, 2, 0)  # words read for the state alone
        start = s.starts[text] + number * stretch - ahead
        size = np.minimum(s.sizes[text] - number * stretch, stretch) + ahead
        order = np.argsort(-size, kind="stable")
        text, start, size, ahead = text[order], start[order], size[order], ahead[order]
        state, score = np.where(ahead > 0, 0, self.begin), np.zeros(len(text))
        for t in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -t))  # stretches of more than t tokens
            state[:m], log = self.step(state[:m].copy(), self.word[start[:m] + t])
            score[:m] += np.where(t >= ahead[:m], log, 0)
        return np.bincount(text, score, len(s.sizes))


def score_documents(docs: DataFrame, mass: tuple[float, float] = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.col("text").cast("string"), F.coalesce(fold("doc_id", FOLDS) != HELD, F.lit(False)).alias("train"), held_out("doc_id", FOLDS, HELD).alias("held_out"))
    blocks = in_blocks(docs, "lm-blocks", BLOCK_BYTES)
    shards = blocks.shards

    def send(block: int, rows: pa.Table) -> pa.Table:
        s = Streams(rows["text"].cast(pa.binary()).to_pylist())
        train, out = np.repeat(rows["train"].to_numpy().astype(np.int64), s.sizes), []
        for kind, keys, weight in ((UNIGRAM, s.tokens, train), (BIGRAM, s.pairs, train), (TRIGRAM, s.triples, train[s.later])):
            order = np.argsort(keys)
            keys, weight = keys[order], weight[order]
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
            out.append(sent(block, kind, keys[heads], np.add.reduceat(weight, heads) if len(heads) else heads, shards))
        return pa.concat_tables(out)

    answers = materialize(totals(blocks.each(send, SENT)), "counts")
    release_shuffles(spark)
    seen = answers.where(F.col("kind") == UNIGRAM).agg(F.sum("n_keys").alias("v"), F.sum("n_total").alias("n")).first()
    types, n = int(seen["v"] or 0), int(seen["n"] or 0)

    def traverse(_: int, rows: pa.Table, got: pa.Table) -> pa.Table:
        s = Streams(rows["text"].cast(pa.binary()).to_pylist())
        model = Automaton(s, [answered(got, kind) for kind in (UNIGRAM, BIGRAM, TRIGRAM)], types, n, mass)
        base, known = np.add.reduceat(model.root[model.word], s.starts), np.add.reduceat((model.count > 0).astype(np.int64)[model.word], s.starts)
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(s.sizes), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(s.sizes), n)), "base_score": pa.array(base), "score": pa.array(model.read(s))})

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.told(answers, traverse, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
