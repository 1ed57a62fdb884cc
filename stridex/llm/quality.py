"""Quality by positive-unlabelled learning: the non-negative unbiased risk, minimised from moments of all documents.

Trusted positives are training documents labelled 1; the unlabelled set is every training document.
Labels 0 are not used: neither by the fit nor by the prior.  A text becomes a short vector of ratios,
expanded by steps into an additive model f.  With squared loss both risks are quadratic in f's
weights, so second moments, summed over all documents in one distributed pass, hold everything the
risk needs: matrices of a fixed size, on which one task descends on
prior*R_p(+1) + max(0, R_u(-1) - prior*R_p(-1)).

The class prior is estimated from positives and unlabelled texts alone.  A least-squares fit of the
ratio of their densities, from the same moments, ranks all documents; among those above a cut that
few negatives reach, the share of unlabelled texts over that of positives comes down to the prior.
The cut with the least such ratio, widened by what chance may do to both shares, decides it.

Defined cases: a null text is empty and gets a score like any other; a document that is labelled
both 1 and 0 is no trusted positive; without any trusted positive every score is the prior, 0.5;
repeated rows count and score each; equal texts have equal scores, and a score on the threshold
counts as 1; an empty table gives no rows; a very long text is read whole, at some 60 bytes a word;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.common import WordHash, fold, grams, held_out, materialize, small_batches

THRESHOLD = 0.3
FOLDS = 5
STEPS = np.array([0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9], np.float32)
N_RATIOS = 18
RIDGE = 1e-4
#: Partial moment matrices meet in so many tasks.
MERGERS = 16
#: Bins of the density ratio, and bounds of an estimated prior.
BINS = 4096
PRIOR_RANGE = (0.01, 0.99)

_CLASS = np.full(256, 9, np.int64)  # 9: other
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&<>", b"!?", b"|", b".,;:'\"-()")):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 10
_MARKS = frozenset(b"#*$%&<>!|@^~=+_")


def ratios(text: bytes, hashes: WordHash) -> np.ndarray:
    """Numbers from 0 to 1 that describe the whole of a text."""
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=11)
    n, letters = max(len(text), 1), max(kinds[0] + kinds[1] + kinds[10], 1)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    h = hashes.array(words)
    w, five = max(len(words), 1), grams(h, 5)
    return np.array(
        [
            kinds[1] / letters,
            *(kinds[2:] / n),
            sum(x[-1] in _MARKS for x in words) / w,
            len(np.unique(h)) / w,
            1 - len(set(lines)) / max(len(lines), 1),
            1 - len(np.unique(five)) / max(len(five), 1),
            min(np.log1p(len(words)) / 12, 1),
            min(len(text) / w / 20, 1),
            min(max(map(len, words), default=0) / 50, 1),
            min(len(lines) / w * 5, 1),
        ],
        np.float32,
    )


def expand(x: np.ndarray) -> np.ndarray:
    """Rows of ratios to rows of the additive model's inputs: one, the ratios, and a step at each cut."""
    steps = (x[:, :, None] > STEPS).reshape(len(x), -1)
    return np.hstack([np.ones((len(x), 1)), x, steps]).astype(np.float64)


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, train and the ratios as bytes."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows = [ratios(t or b"", hashes).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "held_out", "train")} | {"x": pa.array(rows, pa.binary())})

    flagged = docs.select("doc_id", held_out("doc_id", FOLDS, 0).alias("held_out"), F.coalesce(fold("doc_id", FOLDS) != 0, F.lit(False)).alias("train"), "text")
    return flagged.mapInArrow(compute, f"doc_id {id_type}, held_out boolean, train boolean, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_RATIOS)


def moments(table: DataFrame) -> DataFrame:
    """Sums of outer products of the model's inputs over all training rows (u) and over the positive ones (p), for each half of the rows.

    Each task sums over its rows; the sums, of a fixed size, meet in ``MERGERS`` tasks and then in
    one row, ``m``, which is written down.
    """
    d = 1 + N_RATIOS * (1 + len(STEPS))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums = np.zeros((2, 2, d, d))
        for batch in batches:
            z, half, yes = expand(_matrix(batch.column("x"))), batch.column("half").to_numpy(), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            for k in (0, 1):
                u, p = z[half == k], z[(half == k) & yes]
                sums[k] += np.stack([u.T @ u, p.T @ p])
        yield pa.RecordBatch.from_pydict({"merger": pa.array([TaskContext.get().partitionId() % MERGERS]), "m": pa.array([sums.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(4 * d * d)
        for batch in batches:
            for m in batch.column("m"):
                sums += np.frombuffer(m.as_buffer(), np.float64)
        yield pa.RecordBatch.from_pydict({"m": pa.array([sums.tobytes()], pa.binary())})

    sums = table.mapInArrow(partial, "merger long, m binary").repartition(MERGERS, "merger").mapInArrow(merge, "m binary")
    return materialize(sums.repartition(1).mapInArrow(merge, "m binary"), "moments")


def solved(sums: DataFrame, solve: Callable[[list[dict[str, np.ndarray]]], np.ndarray]) -> np.ndarray:
    """What ``solve`` makes of the moments of both halves, worked out in a task; only the weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.column("m"):
                flat = np.frombuffer(m.as_buffer(), np.float64)
                halves = flat.reshape(2, 2, *[math.isqrt(len(flat) // 4)] * 2)
                yield pa.RecordBatch.from_pydict({"w": pa.array([solve([{"u": u, "p": p} for u, p in halves]).tobytes()], pa.binary())})

    return np.frombuffer(sums.mapInArrow(run, "w binary").first()["w"], np.float64)


def ratio_weights(sums: dict[str, np.ndarray]) -> np.ndarray:
    """Least-squares weights of the ratio of the positives' density to that of all; zeros without positives."""
    if not sums["p"][0, 0]:
        return np.zeros(len(sums["p"]))
    a_u, m_p = sums["u"] / sums["u"][0, 0], sums["p"][0] / sums["p"][0, 0]
    return np.linalg.solve(a_u + RIDGE * np.eye(len(a_u)), m_p)


def ranked(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bin of each row's density ratio, by r / (1 + r)."""
    r = np.maximum(expand(x) @ weights, 0)
    return np.minimum((r / (1 + r) * BINS).astype(np.int64), BINS - 1)


def prior_from(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from counts by bin: the least share of unlabelled over positive rows above a cut, allowing for chance."""
    n_u, n_p = unlabelled.sum(), positive.sum()
    q_u, q_p = np.cumsum(unlabelled[::-1]) / n_u, np.cumsum(positive[::-1]) / n_p
    some = q_p > 0
    slack = math.sqrt(math.log(40) / 2) * (1 / math.sqrt(n_u) + 1 / math.sqrt(n_p))
    at = int(np.argmin((q_u[some] + slack) / q_p[some]))
    return float(np.clip(q_u[some][at] / q_p[some][at], *PRIOR_RANGE))


def class_prior(table: DataFrame, sums: DataFrame) -> float:
    """The share of positives among all, from two histograms of a fixed size; 0.5 without any positive.

    A half of the rows is ranked by the fit of the other, so that no row ranks itself.
    """
    weights = solved(sums, lambda halves: np.concatenate([ratio_weights(m) for m in halves[::-1]])).reshape(2, -1)
    if not weights.any():
        return 0.5

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BINS), np.int64)
        for batch in batches:
            x, half, yes = _matrix(batch.column("x")), batch.column("half").to_numpy(), batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
            at = np.where(half == 0, ranked(x, weights[0]), ranked(x, weights[1]))
            both += np.stack([np.bincount(at, minlength=BINS), np.bincount(at[yes], minlength=BINS)])
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_pydict({"bin": pa.array(some), "u": pa.array(both[0, some]), "p": pa.array(both[1, some])})

    rows = table.mapInArrow(count, "bin long, u long, p long").groupBy("bin").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect()
    u, p = np.zeros(BINS), np.zeros(BINS)  # of the bounded number of bins
    for r in rows:
        u[r["bin"]], p[r["bin"]] = r["u"], r["p"]
    return prior_from(u, p)


def fit(sums: dict[str, np.ndarray], prior: float, rounds: int = 300) -> np.ndarray:
    """Weights that minimise the non-negative risk with squared loss (1 - y f)^2 / 4."""
    a_u, a_p = (sums[k] / max(sums[k][0, 0], 1) for k in "up")
    m_u, m_p, d = a_u[0], a_p[0], len(a_u)
    ridge = RIDGE * np.eye(d)
    ridge[0, 0] = 1e-9
    solve = np.linalg.inv(a_u / 2 + ridge)
    if not sums["p"][0, 0]:
        return np.eye(d)[0] * (2 * prior - 1)
    negative = lambda w: (1 + 2 * m_u @ w + w @ a_u @ w) / 4 - prior * (1 + 2 * m_p @ w + w @ a_p @ w) / 4
    positive = lambda w: prior * (1 - 2 * m_p @ w + w @ a_p @ w) / 4
    slope_n = lambda w: (m_u + a_u @ w) / 2 - prior * (m_p + a_p @ w) / 2
    slope_p = lambda w: prior * (a_p @ w - m_p) / 2
    w = best = solve @ (prior * m_p - m_u / 2)
    risk = lambda w: positive(w) + max(0.0, negative(w)) + w @ ridge @ w / 2
    for _ in range(rounds):
        # Where the estimate of the negatives' risk has gone below zero, climb out of it; else descend on the whole.
        step = -slope_n(w) if negative(w) < 0 else slope_p(w) + slope_n(w) + ridge @ w
        w = w - 0.1 * solve @ step
        if risk(w) < risk(best):
            best = w
    return best


def squash(z: np.ndarray, edge: float = 0.02) -> np.ndarray:
    """Identity between the edges, and order-keeping into (0, 1) beyond them."""
    low, high = edge * np.exp(np.minimum(z - edge, 0) / edge), 1 - edge * np.exp(-np.maximum(z - (1 - edge), 0) / edge)
    return np.where(z < edge, low, np.where(z > 1 - edge, high, z))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    table = materialize(featurize(docs), "ratios")
    marked = labels.where(F.coalesce(fold("doc_id", FOLDS) != 0, F.lit(False)) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = marked.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("yes"))
    joined = table.where("train").join(trusted, F.col("doc_id") == F.col("id"), "left").select("x", F.pmod(F.xxhash64("x"), F.lit(2)).cast("int").alias("half"), F.coalesce("yes", F.lit(False)).alias("positive"))
    sums = moments(joined)
    prior = class_prior(joined, sums)
    weights = solved(sums, lambda halves: fit({k: halves[0][k] + halves[1][k] for k in "up"}, prior))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = squash((expand(_matrix(batch.column("x"))) @ weights + 1) / 2)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return table.mapInArrow(apply, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
