"""Each corpus operator against a brute-force version or an exact property, and on the cases its docstring defines."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stridex.llm import common, host_rules, language, lm_score, minhash, mixing, neighbours, packing, quality, substrings, url_filter
from stridex.llm.graphs import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "word", "Two words", "é" * 40, "a" * 100_000, "x y " * 3000, "null\0byte here", " no split\x1c", "THE the ThE"]


def made_docs():
    """Random texts with copies, near copies, shared passages, odd texts, repeated rows and nulls in every column."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    for k in range(0, 20, 2):
        words = texts[k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[4]] + [f"{texts[k]} {passage} {texts[k + 1]}" for k in range(5, 9)] + ODD
    rows = [(i, t, rng.choice(["en", "fr"]), f"src{rng.choice([0, 0, 1, 2])}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[30], (None, "no id at all", None, None, None), (500, texts[2], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def clashing(df):
    """More columns, with names that the operators use inside."""
    extra = {c: F.lit(1) for c in ("block", "row", "key", "rep", "comp", "score", "kept", "pos", "shard", "id", "a", "b", "n_tokens", "copies", "host", "__block", "__had", "__copies", "__copy", "__id", "__source", "__doc", "__c", "__host", "__rejected", "data", "size")}
    return df.withColumns(extra)


def collected(df, drop_null=True):
    return {r.doc_id: r for r in df.collect() if not (drop_null and r.doc_id is None)}


# 1


def test_quality_finds_held_out_labels(spark):
    got = quality.query(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert set(got.held_out) == {True, False} and got.score.between(0, 1).all()
    assert ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.93
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_quality_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    x = np.hstack([np.ones((4000, 1)), rng.normal(size=(4000, 3))])
    y = np.where(x[:, 1] > 0, 1, -1)
    p = x[y == 1][:800]
    w = quality.fit({"u": x.T @ x, "p": p.T @ p}, 0.5)
    assert (np.sign(x @ w) == y).mean() > 0.9
    a_u, a_p = x.T @ x / 4000, p.T @ p / 800
    risk = (1 + 2 * a_u[0] @ w + w @ a_u @ w) / 4 - 0.5 * (1 + 2 * a_p[0] @ w + w @ a_p @ w) / 4
    assert risk > -0.02


def brute_ratios(text):
    """The features in plain Python."""
    import re

    raw = (text or "").encode()
    kinds = [re.compile(x) for x in (rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[ \t\r\x0b\x0c]", rb"\n", rb"[#*$%&<>]", rb"[!?]", rb"\|", rb"[.,;:'\"()-]")]
    k = [len(x.findall(raw)) for x in kinds]
    high = sum(b >= 128 for b in raw)
    n, letters, w = max(len(raw), 1), max(k[0] + k[1] + high, 1), raw.split()
    lines, five = [x for x in raw.split(b"\n") if x.strip()], [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    m = max(len(w), 1)
    return [k[1] / letters, *(x / n for x in k[2:]), (len(raw) - sum(k) - high) / n, high / n, sum(x[-1:] in (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"!", b"|", b"@", b"^", b"~", b"=", b"+", b"_") for x in w) / m, len(set(w)) / m, 1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(five)) / max(len(five), 1), min(math.log1p(len(w)) / 12, 1), min(len(raw) / m / 20, 1), min(max(map(len, w), default=0) / 50, 1), min(len(lines) / m * 5, 1)]


def test_quality_equals_brute_force(spark, docs):
    """Features, moments, prior and score of every document, from plain Python and numpy on all rows at once."""
    rows = [r for r in made_docs()]
    yes = {i for i in range(60) if i % 3}
    labels = spark.createDataFrame([(i, int(i in yes), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    x = np.array([brute_ratios(r[1]) for r in rows], np.float32)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    train = np.array([r[0] is not None and fold(r[0]) != 0 for r in rows])
    positive = train & np.array([r[0] in yes for r in rows])
    half = np.array([r.h for r in spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(x)], "k int, x binary").selectExpr("k", "pmod(xxhash64(x), 2) AS h").orderBy("k").collect()])
    z = np.hstack([np.ones((len(x), 1)), x, (x[:, :, None] > quality.STEPS).reshape(len(x), -1)]).astype(np.float64)
    sums = [{"u": z[train & (half == h)].T @ z[train & (half == h)], "p": z[positive & (half == h)].T @ z[positive & (half == h)]} for h in (0, 1)]
    bins = np.empty(len(x), np.int64)
    for h in (0, 1):
        m = sums[1 - h]
        w = np.linalg.solve(m["u"] / m["u"][0, 0] + quality.RIDGE * np.eye(z.shape[1]), m["p"][0] / m["p"][0, 0])
        r = np.maximum(z[half == h] @ w, 0)
        bins[half == h] = np.minimum((r / (1 + r) * quality.BINS).astype(int), quality.BINS - 1)
    count = lambda some: np.bincount(bins[some], minlength=quality.BINS)
    prior = quality.prior_from(count(train), count(positive))
    w = quality.fit({k: sums[0][k] + sums[1][k] for k in "up"}, prior)
    expected = {r[0]: s for r, s in zip(rows, quality.squash((z @ w + 1) / 2), strict=True)}
    got = collected(quality.score_documents(clashing(docs), labels))
    assert set(got) == {r[0] for r in rows} - {None}
    for i, r in got.items():
        assert r.score == pytest.approx(expected[i], abs=1e-5) and r.held_out == (fold(i) == 0) and r.predicted == int(r.score >= 0.3)


def test_quality_prior_needs_no_negatives():
    """Where positives and others overlap, and all labels are 1."""
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        bins = np.where(rng.random(20_000) < share, rng.integers(40, 100, 20_000), rng.integers(0, 70, 20_000))
        known = rng.integers(40, 100, 5_000)
        assert quality.prior_from(np.bincount(bins, minlength=100), np.bincount(known, minlength=100)) == pytest.approx(share, abs=0.06)


def test_quality_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(clashing(docs), labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(empty, labels).count() == 0
    prior = quality.score_documents(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in prior} == {0.5}


# 2


def test_host_rules_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = host_rules.query(spark, FOLDER)
    expected = con.sql(f"SELECT {', '.join(got.columns)} FROM ({host_rules.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def brute_counts(text):
    w, raw = (text or "").split(), text or ""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", raw)
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in raw.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in raw), len(lines) - len(set(lines)), len(covered)


def test_host_rules_counts_and_verdicts(spark, docs, empty):
    got = host_rules.with_counts(clashing(docs)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)
    rows = [(i, "short", None, "bad", 5) for i in range(40)] + [(100 + i, " ".join(f"w{i}x{k}" for k in range(30)), None, "good", 9) for i in range(40)] + [(200, " ".join(map(str, range(20))), None, "bad", 9), (201, " ".join(map(str, range(20))), None, None, 9)]
    counted = host_rules.with_counts(spark.createDataFrame(rows, SCHEMA))
    verdicts = {r.doc_id: r.kept for r in host_rules.judge(counted, host_rules.host_verdicts(counted)).collect()}
    assert not verdicts[0] and not verdicts[200] and verdicts[100] and verdicts[201]
    nothing = host_rules.with_counts(empty)
    assert host_rules.judge(nothing, host_rules.host_verdicts(nothing)).count() == 0


# 3


def brute_groups(rows, size):
    sets = {}
    for r in rows:
        if r[0] is not None:
            w = [x.lower() for x in words(r[1])]
            sets[r[0]] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(docs, size):
    got = collected(minhash.near_duplicates(clashing(docs), size))
    expected = brute_groups(made_docs(), size)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_rows_of_one_id_are_one_document(spark):
    """Texts A and B are apart; an id that has both links their classes, wherever its rows come in order."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    near = a + " a30"
    for rows, expected in (
        ([(2, a), (4, b), (9, a), (9, b)], {2: 2, 4: 2, 9: 2}),
        ([(1, a), (1, b), (7, b), (8, near), (9, c)], {1: 1, 7: 1, 8: 1, 9: 9}),
        ([(5, a), (5, b), (6, a), (6, b), (3, c)], {5: 5, 6: 5, 3: 3}),
        ([(5, a), (5, c), (6, b), (6, c), (6, a), (6, ""), (4, None)], {5: 5, 6: 5, 4: 4}),
    ):
        for some in (rows, rows[::-1]):
            got = minhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string"), 2).collect()
            assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got if r.n_shingles or r.doc_id == 4} == expected


def test_near_duplicate_chains(spark, empty):
    # Each text is near the next one only, so that no centre links them all.
    base = [f"w{k}" for k in range(100)]
    chain = [(k, " ".join(base[8 * k :] + [f"n{j}" for j in range(8 * k)])) for k in range(6)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()}
    assert got == {k: v[1] for k, v in brute_groups(chain, 2).items()}
    assert minhash.near_duplicates(empty, 2).count() == 0


def test_minhash_estimate_is_close(spark):
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.r_[a[:900], np.unique(rng.integers(0, 1 << 63, 100).astype(np.uint64))]
    low = lambda s: minhash.packed(minhash.minima(s)).view(np.int64).tolist()
    e = spark.createDataFrame([(low(a), low(b))], "x array<long>, y array<long>").select(minhash.estimate(F.col("x"), F.col("y"))).first()[0]
    assert abs(e - 900 / 1100) < 0.12


@pytest.mark.parametrize("length", [5, 6])
def test_near_duplicate_families_of_short_texts(spark, length):
    """In each family the last text is linked with all others, which are apart from each other, at or near the threshold."""
    rows = []
    for family in range(150):
        base = " ".join(f"w{family}x{k}" for k in range(length))
        rows += [(5 * family + k, text) for k, text in enumerate([*(f"{base} t{k}" for k in range(3)), f"head {base}", base])]
    got = collected(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == brute_groups(rows, 2)


def test_kept_bits_agree_by_chance_only():
    """Links of short sets at exactly the threshold, by the sketch alone."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = np.unique(rng.integers(0, 1 << 63, 5, dtype=np.uint64))
        x, y = (minhash.packed(minhash.minima(v, minhash.FINE)) for v in (s, s[:4]))
        d = x ^ y
        equal = 1 - np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum() / minhash.FINE
        assert (equal - 0.25) / 0.75 >= minhash.THRESHOLD / 100 - minhash.FINE_SLACK


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 1), (4, 5), (5, 4), (20, 21)] + [(k, k + 1) for k in range(30, 60)], "a long, b long")
    got = {r.id: r.comp for r in components(links).collect()}
    assert got[9] == got[8] == 1 and got[5] == 4 and got[21] == 20 and got[60] == 30
    assert components(links.limit(0)).count() == 0


# 4


def test_language_held_out(spark):
    got = language.query(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_code_length_is_exact():
    texts = {"x": [b"abracadabra", b"abc"], "y": [b"zyzzyva"]}
    counts = {}
    for lang, ts in texts.items():
        c = language.codes(ts)[0]
        counts[lang] = np.unique(c[(c & 255) != 0], return_counts=True)
    model = language.Model(counts)

    def brute(lang, text):
        seen = Counter()
        for t in texts[lang]:
            padded = b"\0\0\0" + t
            for i in range(3, len(padded)):
                for order in range(4):
                    seen[padded[i - order : i + 1]] += 1
        bits, padded = 0.0, b"\0\0\0" + text
        for i in range(3, len(padded)):
            p = 1 / 256
            for order in range(4):
                after = {k: n for k, n in seen.items() if len(k) == order + 1 and k[:order] == padded[i - order : i]}
                if after:
                    n, kinds, hit = sum(after.values()), len(after), after.get(padded[i - order : i + 1])
                    p = hit / (n + kinds) if hit else kinds / (n + kinds) * p
            bits += math.log2(p)
        return bits

    got = model.totals([b"abra", b"", b"zq\xff"])
    for k, t in enumerate([b"abra", b"", b"zq\xff"]):
        assert got[k] == pytest.approx([brute("x", t), brute("y", t)], rel=1e-5, abs=1e-9)


def test_language_keeps_small_languages(spark, tmp_path):
    """A language of few texts, in which no four bytes come twice, beside one that brings over a million entries."""
    rng = random.Random(8)
    latin = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789  "
    rows = [(k, "".join(rng.choices(latin, k=20_000)), "big") for k in range(120)]
    seen = set()
    while len(rows) < 140:
        # Each text has a first byte of its own.
        text = chr(rng.randrange(64 * (len(rows) - 116), 64 * (len(rows) - 115))) + "".join(chr(rng.randrange(0x100, 0x600)) for _ in range(3))
        new = language.codes([text.encode()])[0][3:].tolist()
        if any(x.isalpha() for x in text) and not seen & set(new):
            seen |= set(new)
            rows.append((len(rows), text, "small"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in language.query(spark, str(tmp_path)).collect()}
    held = [i for i, r in got.items() if r.held_out and i >= 120]
    assert len(got) == 140 and held and {got[i].lang_pred for i in held} == {"small"}


def test_language_in_shards_equals_one_piece(docs, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(language, "CHUNK", 1_000)
    whole = language.identify(docs, language.train(docs))
    parts = language.learn_and_identify(clashing(docs), docs)
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect()))
    assert {r.lang_pred for r in language.learn_and_identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.learn_and_identify(docs.limit(0), docs).count() == 0


def test_language_odd_cases(docs, empty):
    model = language.train(docs)
    got = language.identify(clashing(docs), model).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got} <= {"en", "fr", "und"}
    by_id = {r.doc_id: r for r in got}
    texts = {r[0]: r[1] for r in made_docs()}
    assert all((r.lang_pred == "und") == (texts[i] is None or not any(c.isalpha() for c in texts[i])) for i, r in by_id.items())
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(empty)).collect()} == {"und"}
    pruned = language.train(docs, max_entries=50)
    assert len(pruned.keys) <= 50 and language.identify(docs, pruned).count() == docs.count()


# 5


def check_packing(rows, capacity=2048):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(packing.pieces(clashing(docs), keep_ids=True).cache()).collect()
    n = check_packing(rows)
    assert n <= sum(r.length for r in rows) / 2048 * 1.1 + 2
    ids = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
        ids[r.doc_id][r.piece] = bytes(r.ids)
    for i, text, *_ in made_docs():
        expected = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(ids[i][k] for k in sorted(ids[i])) == expected
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_packing_follows_the_rule():
    rng = random.Random(3)
    sizes = [rng.randint(1, 20) for _ in range(300)]
    bins, offsets = packing.place(np.array(sizes), 20)
    used: dict[int, int] = {}
    for size, b, offset in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        gaps = Counter(20 - u for u in used.values() if u < 20)

        def total(gap):
            after = gaps.copy()
            after[gap] -= 1
            after[gap - size] += 1
            return sum(n * n for g, n in after.items() if 0 < g < 20)

        best = min(total(g) for g in {*(g for g in gaps if g >= size), 20})
        gap = 20 - used.get(b, 0)
        assert offset == used.get(b, 0) and total(gap) == best
        used[b] = used.get(b, 0) + size


def test_tokens_by_unit_equal_the_tokenizer():
    ids = packing.UnitIds(packing.tokenizer_path())
    rng = random.Random(0)
    alphabet = "ab<|endoftext|> \t\n\x0b\x0c\r\x1c\x85 'sTré́ÉßéŞİΣς1²٣#💥AllVEre'd't×÷ªµ.!"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(30))
        expected = np.array(ids.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(packing.token_bytes([text.encode()], ids)) == [expected]


# 6


def test_mixing_meets_budgets(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 50)), "en", rng.choice(["big"] * 8 + ["mid"] * 2 + ["small", None]), 1) for i in range(600)]
    rows += [rows[0], (None, "one two", None, "mid", None), (700, None, None, "mid", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    units = clashing(df).select("doc_id", "source", mixing.word_count().alias("n_tokens"))
    got = mixing.mix(units, target_entropy=0.8, repeats=2.0).collect()
    assert len(got) == 602
    tokens, realised, weight, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
        realised[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
        largest[r.source] = max(largest[r.source], r.n_tokens)
    total = sum(tokens.values())
    entropy = -sum(w * math.log(w) for w in weight.values())
    over = max(weight[s] * total / tokens[s] for s in tokens)
    assert sum(weight.values()) == pytest.approx(1)
    assert abs(entropy - 0.8 * math.log(4)) < 1e-4 or abs(over - 2.0) < 1e-4
    alpha = [math.log(weight[s] / weight["big"]) / math.log(tokens[s] / tokens["big"]) for s in tokens if s != "big"]
    assert max(alpha) - min(alpha) < 1e-9
    for s in tokens:
        assert 0 <= weight[s] * total - realised[s] + 1e-6 and weight[s] * total - realised[s] < 2 * largest[s]
    out = mixing.realise(df, mixing.mix(units, target_entropy=0.8, repeats=2.0))
    assert out.columns == df.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert all(copies[r.doc_id] == r.copies * (2 if r.doc_id == 0 else 1) for r in got)
    assert mixing.mix(empty.select("doc_id", "source", mixing.word_count().alias("n_tokens"))).count() == 0


def test_mixing_equals_brute_force(spark):
    """Copies, blocks and their order, worked out again from hashes that Spark gives."""
    rng = random.Random(12)
    rows = [(i, rng.choice(["big"] * 7 + ["mid"] * 2 + ["small"]), rng.randint(0, 90)) for i in range(700)]
    units = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    mixing_block = mixing.BLOCK_TOKENS
    try:
        mixing.BLOCK_TOKENS = 1500
        got = {r.doc_id: r for r in mixing.mix(units, target_entropy=0.85).collect()}
    finally:
        mixing.BLOCK_TOKENS = mixing_block
    hashed = {r.doc_id: (r.x, r.y) for r in units.select("doc_id", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("x"), F.xxhash64("doc_id", F.lit(mixing.SEED + 1)).alias("y")).collect()}
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    total = sum(tokens.values())

    def weights(alpha):
        power = {s: (n / total) ** alpha for s, n in tokens.items()}
        return {s: p / sum(power.values()) for s, p in power.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        enough = -sum(w * math.log(w) for w in weights(mid).values()) >= 0.85 * math.log(3)
        low, high = (mid, high) if enough else (low, mid)
    weight = weights(low)
    if max(weight[s] * total / tokens[s] for s in tokens) > mixing.REPEAT_LIMIT:
        low, high = low, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if max(w * total / tokens[s] for s, w in weights(mid).items()) > mixing.REPEAT_LIMIT else (low, mid)
        weight = weights(high)
    for s in tokens:
        goal, blocks = weight[s] * total, -(-tokens[s] // 1500)
        passes = math.floor(goal / tokens[s] + 1e-6)
        room, mine = max(0.0, goal - passes * tokens[s]), defaultdict(list)
        for i, source, n in rows:
            if source == s:
                mine[hashed[i][0] % blocks].append((hashed[i][1], i, n))
        place = {r.block: r.h for r in spark.createDataFrame([(s, b) for b in mine], "source string, block long").select("block", F.xxhash64("source", "block", F.lit(mixing.SEED)).alias("h")).collect()}
        for rank, b in enumerate(sorted(mine, key=lambda b: (place[b], b))):
            size = sum(n for _, _, n in mine[b])
            upto, full = 0, size <= room
            for key, i, n in sorted(mine[b]):
                upto += n
                r = got[i]
                assert (r.block, r.block_rank, r.order_key) == (b, rank, key) and r.weight == pytest.approx(weight[s], rel=1e-6)
                assert r.copies == passes + (room > 0 and (full or upto <= room))
            room -= size


# 7


def brute_scores(rows, mass):
    """Per id the contract's counts, and base and model scores by the formula, without any automaton."""
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    stream = lambda t: ["BEGIN", *(w.lower() for w in words(t)), "END"]
    grams = Counter()
    for r in train:
        s = stream(r[1])
        for k in range(1, len(s)):
            for size in (1, 2, 3):
                if k - size + 1 >= 0:
                    grams[tuple(s[k - size + 1 : k + 1])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    followed = Counter()
    for g, c in grams.items():
        followed[g[:-1]] += c
    p1 = lambda w: (grams[w,] + 1) / (n + v + 1)
    p2 = lambda h, w: (grams[h, w] + mass[0] * p1(w)) / (followed[h,] + mass[0])
    p3 = lambda g, h, w: (grams[g, h, w] + mass[1] * p2(h, w)) / (followed[g, h] + mass[1])
    found = {}
    for i, text, *_ in rows:
        s = stream(text)
        model = [p2(*s[:2]), *(p3(*s[k - 2 : k + 1]) for k in range(2, len(s)))]
        found[i] = len(s) - 1, sum(grams[w,] > 0 for w in s[1:]), n, sum(math.log10(p1(w)) for w in s[1:]), sum(map(math.log10, model))
    return found


@pytest.mark.parametrize(("stretch", "block_bytes"), [(512, 10_000_000), (3, 5_000)])
def test_lm_scores_equal_brute_force(docs, empty, monkeypatch, stretch, block_bytes):
    """With short stretches and small blocks as with long ones."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block_bytes)
    read = lm_score.Automaton.read
    monkeypatch.setattr(lm_score.Automaton, "read", lambda self, s: read(self, s, stretch))
    got = collected(lm_score.score_documents(clashing(docs)))
    for i, expected in brute_scores(made_docs(), lm_score.MASS).items():
        if i is not None:
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == expected[:3]
            assert r.base_score == pytest.approx(expected[3]) and r.score == pytest.approx(expected[4])
            assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert lm_score.score_documents(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    texts = [b"a b a c", b"a b b", b"", b"c a b"]
    s = lm_score.Streams(texts)
    counts = [np.unique(x, return_counts=True)[1] for x in (s.tokens, s.pairs, s.triples)]
    model = lm_score.Automaton(s, counts, len(counts[0]), len(s.tokens), lm_score.MASS)
    end = 1 + model.word[s.sizes[0] - 1]
    for state in range(len(model.fail)):
        if end in (state, model.fail[state]):
            continue  # nothing is read after the end
        every = np.arange(len(model.root))
        log = model.step(np.full(len(every), state), every)[1]
        # One class of unknown words has what is left.
        unknown = 1 / (len(s.tokens) + len(every) + 1)
        at = state
        while at:
            unknown, at = unknown * 10 ** model.weight[at], model.fail[at]
        assert (10**log).sum() + unknown == pytest.approx(1)


# 8


def test_urls_equal_sql_and_rules(spark):
    con = duckdb.connect()
    odd = [None, "", "no host", "http://", "HTTP://WWW.Example.ORG/es/1?q", "http://org", "http://a.org/", "http://xexample.org/en/1", "http://a.example.org/en/12#x", "http://b.com/FR/", "http://b.com/fr/x", "http://com/de/?u=http://z", "http://porn.net", "http://unporn.net", "http://free.net/ads", "http://free.net/free", "http://n.net?ads-track", "://x/y", "http://é.net/casino!"]
    rows = [(i, u) for i, u in enumerate(odd)] + [(3, "http://")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    got = url_filter.judge_urls(pages)
    expected = con.sql(f"SELECT {', '.join(got.columns)} FROM ({url_filter.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    verdict = {r.page_id: (r.rule, r.verdict) for r in got.collect()}
    assert verdict[4] == ("example.org/es/", "block") and verdict[5] == (None, "allow") and verdict[12] == (None, "block") and verdict[13] == (None, "allow")


def test_urls_by_tables(spark):
    """Vocabulary and rules from tables, with clashing columns, and an empty table of pages."""
    terms = spark.createDataFrame([("BAD", "strict"), ("bad", "soft"), ("a", "soft"), ("b", "soft"), ("", "strict"), (None, "soft")], "term string, weight string")
    strict, soft = url_filter.vocabulary_of(terms)
    assert strict == ["bad"] and soft == ["a", "b", "bad"]
    rules = url_filter.rules_of(spark.createDataFrame([("x.net", "/p", "allow"), ("net", "/p/long", "block"), ("x.net", "/p/", "block"), (None, "/", "allow")], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(1, "http://x.net/p/long"), (2, "http://y.x.net/pq"), (3, "http://x.net/p/l"), (4, "http://q/Bad"), (5, "http://q/badly"), (6, "http://a/b"), (7, "http://a/a"), (8, "http://" + "y." * 5000 + "net/p/long")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages.withColumns({"rule": F.lit(1), "path": F.lit(2)}), strict, soft, rules).collect()}
    assert got == {1: ("net/p/long", "block"), 2: ("x.net/p", "allow"), 3: ("x.net/p/", "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "block"), 7: (None, "allow"), 8: ("net/p/long", "block")}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, [], [], []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.vocabulary_of(spark.range(10).selectExpr("repeat(cast(id AS string), 10000000) AS term", "'soft' AS weight"))


# 9


def brute_removed(rows, window):
    found, seen = {}, {}
    for i, text in sorted({(r[0], r[1] or "") for r in rows if r[0] is not None}):
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen[g] = True
        found[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone, strict=True) if not y)).hexdigest())
    return found


@pytest.mark.parametrize(("window", "prefix", "hot", "block_bytes"), [(20, 8, 20_000, 10_000_000), (20, 8, 1, 2_000), (12, 12, 20_000, 10_000_000), (9, 4, 3, 20_000), (50, 8, 20_000, 2_000)])
def test_substrings_equal_brute_force(docs, monkeypatch, window, prefix, hot, block_bytes):
    """Also where most prefixes are hot and have to grow, and where documents lie in many blocks."""
    monkeypatch.setattr(substrings, "GROUP_ROWS", hot)
    monkeypatch.setattr("stridex.llm.blocks.BLOCK_BYTES", block_bytes)
    got = collected(substrings.digest(clashing(docs), window, prefix))
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == brute_removed(made_docs(), window)


def test_substring_removal_keeps_layout_and_columns(spark, docs, empty):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"one\n{passage} tail", "en", "s", 1), (2, f"two  {passage}\nend\n", "en", "s", 1), (3, passage, None, None, None), (4, None, None, None, None)]
    got = {r.doc_id: r for r in substrings.stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got[1].text == f"one\n{passage} tail" and got[2].text == "two  end\n" and got[2].n_chars == 9
    assert 3 not in got and got[4].text is None
    spans = substrings.passages(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    assert [tuple(r) for r in spans] == [(2, 1, 60), (3, 0, 60)]
    kept = substrings.remove(clashing(docs))
    assert kept.columns == clashing(docs).columns and kept.count() == docs.count()
    assert substrings.digest(empty).count() == 0


# 10


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:720] = x[5]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = neighbours.nearest(df, lambda i: i % 50 == 0, 5).toPandas()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        s = unit @ unit[q]
        assert np.allclose(part.score, s[part.vec_id]) and q not in set(part.vec_id) and list(part["rank"]) == [1, 2, 3, 4, 5]
        assert (np.diff(part.score) <= 1e-12).all()
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]) & set(part.vec_id))
    assert got.query_id.nunique() == 30 and hits / 150 > 0.95
    assert got[got.query_id == 700].vec_id.tolist() == [5, 701, 702, 703, 704]


def test_neighbours_within_a_tight_cluster(spark):
    """A third of the rows are near-copies of one vector, none equal; recall is of their queries alone."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + 0.001 * rng.normal(size=(1000, 64))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, lambda i: i % 75 == 0, 5).toPandas()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hits = 0
    for q, part in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(part.vec_id))
    assert got.query_id.nunique() == 40
    assert hits / 200 > 0.9, hits / 200


def test_neighbours_odd_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [2.0, 0.0]), (150, [-1.0, 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "id": F.lit(2), "near": F.lit(3)})
    got = [tuple(r) for r in neighbours.nearest(df, lambda i: i % 50 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 4, 0.0), (0, 3, 150, -1.0), (150, 1, 4, 0.0), (150, 2, 0, -1.0), (150, 3, 3, -1.0)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 50 == 0, 5).count() == 0


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(made_docs(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    current, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, str(tmp_path)).cache()
        seen.append((name, out.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        current = out
    assert [n for n, _ in seen] == ["quality_rules", "near_duplicates", "repeated_passages", "temperature_mixing", "best_fit_packing"]
    assert all(c > 0 for _, c in seen) and seen[0][1] > seen[1][1]
    check_packing(current.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_tasks_leave_a_small_worker():
    """What a worker's process holds after a task: free pieces go back to the system, and other operators' memories go."""
    import re
    from pathlib import Path

    resident = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) // 1024
    last, most = [], []

    def hold(batches):
        # Pieces that malloc takes from its heap; the last one stays and pins the heap's end.
        pieces = [np.ones(12_000) for _ in range(3000)]
        last.append(pieces[-1])
        most.append(resident())
        yield from batches

    before = resident()
    packing._LOADED["test"] = {}
    try:
        assert list(common.lean(keep=True)(hold)([1, 2])) == [1, 2]
        assert most[0] > before + 200 and resident() < before + 100
        assert "test" in packing._LOADED
        assert list(common.lean(lambda batches: iter(batches))([3])) == [3]
        assert not packing._LOADED
    finally:
        packing._LOADED.pop("test", None)


def test_workers_of_the_pipeline_are_lean():
    """Every function over batches that the pipeline sends out gives its memory back."""
    import inspect as py

    from stridex.llm import blocks

    for module in (minhash, substrings, packing, blocks):
        source = py.getsource(module).split("\n")
        for k, line in enumerate(source):
            if line.lstrip().startswith("def ") and "(batches" in line:
                assert source[k - 1].lstrip().startswith("@lean"), line


def test_pipeline_of_nothing(spark, tmp_path, empty):
    import corpus_pipeline

    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_pass_clashing_columns_through(spark, docs):
    import corpus_pipeline

    more = clashing(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, "")
        assert out.columns == more.columns and out.where("__copies = 1 AND __had = 1 AND __c = 1 AND host = 1").count() == out.count() > 0
