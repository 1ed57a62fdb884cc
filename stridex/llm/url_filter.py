"""Weighted URL vocabulary: one Aho-Corasick pass counts strict and soft terms between boundaries.

A term counts where no ASCII letter or digit touches it.  One strict term, or ``SOFT_LIMIT``
distinct soft terms, block a url; a host/path rule that fits comes before that.  Vocabulary and rules
are parameters: lists, or tables (``vocabulary_of``, ``rules_of``) of up to ``MOST_BYTES``, as every
task holds them.  Rules are found by looking up each parent of the host and each length of path that
it has rules for, so their number does not matter to a url.

Defined cases: a null url, or one without ``://``, has an empty host and path, so no rule fits; a
null url holds no term and is allowed; a term that is both strict and soft is strict; of rules that
fit the longest (host and path) wins, of equal rules the last in order of verdict; repeated rows are
judged each; an empty table gives no rows; a very long url is read once, whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridex.llm.common import small_batches

STRICT = ["casino", "cheap-pills", "escorts", "free-bets", "porn", "spam-farm", "viagra", "warez", "xxx"]
SOFT = ["ads", "adult", "bet", "bets", "bonus", "cheap", "click", "dating", "deals", "farm", "free", "loans", "pills", "poker", "promo", "spam", "track", "tracker", "win"]
SOFT_LIMIT = 2
#: Bytes of terms or of rules that a task may hold.
MOST_BYTES = 64 << 20
#: Host, path prefix, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:cut].translate(str.maketrans(UPPER, LOWER)), tail[:end]


class Rules:
    """Rules by host and path."""

    def __init__(self, rules):
        self.by_host: dict[str, dict[str, str]] = {}
        for host, path, verdict in sorted(rules):
            self.by_host.setdefault(host, {})[path] = verdict
        self.lengths = {h: sorted({len(p) for p in paths}, reverse=True) for h, paths in self.by_host.items()}

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits host (or a parent domain) and path prefix, and its verdict."""
        best = None
        parent = host
        while True:
            for n in self.lengths.get(parent, ()):
                if n <= len(path) and path[:n] in self.by_host[parent]:
                    found = len(parent) + n, parent + path[:n], self.by_host[parent][path[:n]]
                    best = max(best, found) if best else found
                    break
            _, dot, parent = parent.partition(".")
            if not dot:
                return best[1:] if best else None


def _bounded(rows: DataFrame, *columns: str) -> list[tuple]:
    """All rows of a table whose size has been checked."""
    size = rows.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(16))).alias("n")).first()["n"] or 0
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of terms or rules; every task holds them, so {MOST_BYTES} at most")
    return [tuple(r) for r in rows.select(*columns).distinct().collect()]


def vocabulary_of(terms: DataFrame) -> tuple[list[str], list[str]]:
    """Strict and soft terms, A-Z lower-cased, from a table (term, weight: strict or soft); null and empty terms are none."""
    rows = _bounded(terms.where("term <> ''").select(F.translate("term", UPPER, LOWER).alias("term"), "weight"), "term", "weight")
    return sorted(t for t, w in rows if w == "strict"), sorted(t for t, w in rows if w == "soft")


def rules_of(rules: DataFrame) -> list[tuple[str, str, str]]:
    """Rules from a table (host, path, verdict); rows with a null are none."""
    return sorted(_bounded(rules.dropna(subset=["host", "path", "verdict"]), "host", "path", "verdict"))


def automaton(strict=STRICT, soft=SOFT):
    import ahocorasick

    found = ahocorasick.Automaton()
    # Strict terms come last, as a term has one weight.
    for weight, terms in (("soft", soft), ("strict", strict)):
        for term in terms:
            found.add_word(term, (weight, term))
    if len(found):
        found.make_automaton()
    return found


def term_hits(url: str, terms) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand between boundaries."""
    low = url.translate(str.maketrans(UPPER, LOWER))
    inside = frozenset(LOWER + "0123456789")
    hits: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for end, (weight, term) in terms.iter(low) if len(terms) else ():
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in inside) and (end + 1 == len(low) or low[end + 1] not in inside):
            hits[weight].add(term)
    return hits["strict"], hits["soft"]


def judge_urls(pages: DataFrame, strict=STRICT, soft=SOFT, rules=RULES, limit: int = SOFT_LIMIT) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the numbers of distinct strict and soft terms."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, index = automaton(strict, soft), Rules(rules)
        for batch in batches:
            rows = {k: [] for k in ("host", "path", "rule", "verdict", "n_strict", "n_soft")}
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                hard, mild = term_hits(url or "", terms)
                rule = index.match(host, path)
                by_terms = "block" if hard or len(mild) >= limit else "allow"
                for k, v in zip(rows, (host, path, rule[0] if rule else None, rule[1] if rule else by_terms, len(hard), len(mild)), strict=True):
                    rows[k].append(v)
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id")} | {k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    small_batches(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _hits(terms: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)


ORACLE = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, low, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, low, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT *, {_hits(STRICT)} AS n_strict, {_hits(SOFT)} AS n_soft,
    (SELECT max_by([h || q, v], length(h || q)) FROM (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in RULES)}) AS t(h, q, v)
     WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS best
  FROM p
)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM r
"""
