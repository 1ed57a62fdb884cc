"""Quality rules by host, native: counts per document, failure rates per host, verdicts joined back.

Each document gets five counts and four rule outcomes from SQL expressions alone.  Failures are
summed by host (``source``); each rule's rates get a beta prior fitted to all hosts by moments, and
a host whose shrunk rate exceeds a rule's limit is rejected with all of its documents.

Defined cases: a null text has no words, so it fails the base rule; a null host is judged by the
base rule alone; repeated rows count each time; a rate on a limit does not reject; an empty table
gives an empty result; a very long text is judged whole, its words and windows in one row's arrays;
other columns pass through untouched (the count columns replace columns of the same name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.common import materialize
from stridex.operators.tiles import fresh

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A host is rejected if its shrunk failure rate in one of these rules is above the limit.
HOST_LIMITS = {"short": 0.5, "repeats": 0.5, "symbols": 0.5, "lines": 0.5}
#: Hosts up to this number are broadcast (some MB); beyond it the join shuffles, with AQE splitting hot hosts.
BROADCAST_HOSTS = 50_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of five words which the text holds twice or more.

    Windows compare by 64-bit hash: within one text of a million words a chance collision has odds below 1e-7.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: F.least(F.lit(WINDOW), F.element_at(starts, k + 1) - F.element_at(starts, k)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)

    def paired(ordered: Column) -> Column:
        # The value before and after each entry decides if its window occurs again.
        same = lambda e, k: F.coalesce(F.try_element_at(ordered, k)["h"] == e["h"], F.lit(False))
        twins = F.filter(ordered, lambda e, k: F.when(k > 0, same(e, k)).otherwise(False) | same(e, k + 2))
        return let(F.sort_array(F.transform(twins, lambda e: e["i"])), covered)

    def windows(w: Column) -> Column:
        at = lambda i: [F.element_at(w, i + k) for k in range(WINDOW)]
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*at(i)))

    def counted(h: Column) -> Column:
        tagged = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(tagged), paired))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows(words), counted))


def counts(text: str = "text") -> Column:
    """A struct of the five counts of a text."""
    raw = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(raw, SPACE), lambda w: w != "")
    # A line with a word holds a character other than the six spaces.
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(x).cast("long").alias("n_lines")))
    chars = F.length(F.regexp_replace(raw, SPACE, "")).cast("long")
    symbols = (F.length(raw) - F.length(F.regexp_replace(raw, r"[#*$%&|<>]+", ""))).cast("long")
    return F.struct(per_words.alias("w"), per_lines.alias("l"), chars.alias("c"), symbols.alias("s"))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts and ``base_failed``."""
    c, = fresh([*docs.columns, *COUNTS], "c")
    out = docs.withColumn(c, counts(text))
    out = out.withColumns(
        {
            "n_words": F.col(f"{c}.w.n_words"),
            "word_chars": F.col(f"{c}.c"),
            "n_symbols": F.col(f"{c}.s"),
            "n_dup_lines": F.col(f"{c}.l.n_dup_lines"),
            "n_lines": F.col(f"{c}.l.n_lines"),
            "n_repeat_words": F.col(f"{c}.w.n_repeat_words"),
        }
    ).drop(c)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rule_outcomes() -> dict[str, Column]:
    return {
        "short": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    }


def host_verdicts(counted: DataFrame, host: str = "source") -> DataFrame:
    """One row per non-null host: ``host``, ``host_docs``, a shrunk rate per rule and ``host_rejected``.

    Hosts are pre-aggregated before the shuffle, so a host with a third of all rows sends one row a task.
    The prior of a rule is Beta(k*m, k*(1-m)): m is the rate over all documents, k follows from the
    spread of the hosts' rates (weighted by documents), at least 1 and at most a million.
    """
    rules = rule_outcomes()
    hosts = materialize(
        counted.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("host_docs"), *[F.sum(c.cast("long")).alias(f"bad_{r}") for r, c in rules.items()]),
        "hosts",
    )
    rate = lambda r: F.col(f"bad_{r}") / F.col("host_docs")
    total = hosts.agg(F.sum("host_docs").alias("n"), *[F.sum(f"bad_{r}").alias(r) for r in rules]).first()
    if not total["n"]:
        shrunk = {r: F.lit(0.0) for r in rules}
    else:
        mean = {r: total[r] / total["n"] for r in rules}
        spread = hosts.agg(*[(F.sum(F.col("host_docs") * F.pow(rate(r) - mean[r], 2)) / total["n"]).alias(r) for r in rules]).first()
        weight = {r: min(max(mean[r] * (1 - mean[r]) / spread[r] - 1, 1.0), 1e6) if spread[r] > 0 else 1e6 for r in rules}
        shrunk = {r: (F.col(f"bad_{r}") + weight[r] * mean[r]) / (F.col("host_docs") + weight[r]) for r in rules}
    rejected = F.lit(False)
    for r, limit in HOST_LIMITS.items():
        rejected = rejected | (shrunk[r] > limit)
    return hosts.select("host", "host_docs", *[shrunk[r].alias(f"rate_{r}") for r in rules], rejected.alias("host_rejected"))


def judge(counted: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """``counted`` with ``host_rejected`` and ``kept``."""
    name, mark = fresh([*counted.columns, host], "host", "rejected")
    verdicts = hosts.where("host_rejected").select(F.col("host").alias(name), F.lit(True).alias(mark))
    if hosts.where("host_rejected").limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    out = counted.join(verdicts, F.col(host) == F.col(name), "left")
    out = out.withColumn("host_rejected", F.coalesce(mark, F.lit(False))).drop(name, mark)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = materialize(with_counts(docs.select("doc_id", "source", "text")).drop("text"), "counts")
    return judge(table, host_verdicts(table)).select("doc_id", *COUNTS, "base_failed", "host_rejected", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with the columns they came with, whatever their names.

    Counts are taken once and written with the documents, so that neither hosts nor verdicts take
    them again and no text is shuffled.  Cases are as above.
    """
    tagged = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("host"), F.col("text").alias("words"))
    counted = materialize(with_counts(tagged, "words").drop("words"), "counted")
    return judge(counted, host_verdicts(counted, "host"), "host").where("kept").select("doc.*")


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, source, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM raw
), grams AS (
  SELECT *, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) AS gs FROM split
), marked AS (
  SELECT *, list_filter(map_entries(list_histogram(gs)), lambda e: e.value > 1) AS dups FROM grams
), placed AS (
  SELECT *, CASE WHEN len(dups) = 0 THEN [] ELSE
    list_filter(range(1, len(gs) + 1), lambda i: list_contains(list_transform(dups, lambda e: e.key), gs[i])) END AS ps FROM marked
), counted AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(CASE WHEN len(ps) = 0 THEN 0 ELSE len(list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 5))))) END AS BIGINT) AS n_repeat_words
  FROM placed
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CAST(n_words < 10 AS INT) AS r1, CAST(100 * n_repeat_words > 20 * n_words AS INT) AS r2,
    CAST(100 * n_symbols > 10 * word_chars AS INT) AS r3, CAST(100 * n_dup_lines > 30 * n_lines AS INT) AS r4
  FROM counted
), hosts AS (
  SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule, unnest([sum(r1), sum(r2), sum(r3), sum(r4)]) AS bad
  FROM judged WHERE source IS NOT NULL GROUP BY source
), means AS (
  SELECT rule, sum(bad) / sum(n) AS m FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, any_value(m) AS m, sum(n * pow(bad / n - m, 2)) / sum(n) AS v FROM hosts JOIN means USING (rule) GROUP BY rule
), weights AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM priors
), rejected AS (
  SELECT DISTINCT source FROM hosts JOIN weights USING (rule) WHERE (bad + k * m) / (n + k) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  r.source IS NOT NULL AS host_rejected, NOT base_failed AND r.source IS NULL AS kept
FROM judged LEFT JOIN rejected r ON judged.source = r.source
"""
