"""Runs of words against a plain search over all periods and places."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from seisframe.llm.periodic_runs import COVER, COVER_PERIOD, SHIFT, Extensions, collapse_runs, digest, greatest, runs_of

from .helpers import SCHEMA, corpus, docs


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in found.items())


def looped_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute(rows):
    out = []
    for i, text, *_ in rows:
        words = looped_words(i, text)
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
        gone = {j for s, q, n in runs for j in range(s + q, s + n)}
        listed = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        four = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        out.append((i, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in digest(collapse_runs(df, F.crc32(F.col("doc_id").cast("string").cast("binary")))).collect()), key=str)


def test_cover_has_every_difference():
    assert {(a - b) % COVER_PERIOD for a in COVER for b in COVER} == set(range(COVER_PERIOD))
    assert SHIFT.max() < COVER_PERIOD


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(3)
    for seq in (rng.integers(0, 2, 400), np.tile(rng.integers(0, 9, 70), 6), np.zeros(150, int), np.arange(5), np.arange(0)):
        ext, n = Extensions(seq), len(seq)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        pick = rng.permutation(len(i))[:4000]
        i, j = i[pick], j[pick]
        expected = [next((k for k in range(n) if max(a, b) + k >= n or seq[a + k] != seq[b + k]), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(i) == 0 or ext(i, j).tolist() == expected


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(120):
        texts = []
        for _ in range(rng.randint(0, 12)):
            n, kinds = rng.choice([0, 1, 5, 23, 24, 25, 60, 100, 300]), rng.choice([1, 2, 3, 50])
            words = [rng.randrange(kinds) for _ in range(n)]
            for _ in range(rng.randint(0, 3)):
                a, q = rng.randrange(n + 1), rng.randint(1, 30)
                for i in range(a + q, min(n, a + rng.randint(10, 120))):
                    words[i] = words[i - q]
            texts.append(words)
        got = [[(s, q, n) for s, n, q in zip(*(x.tolist() for x in r), strict=True)] for r in runs_of([np.array(t, np.int64) for t in texts])]
        assert got == [brute_runs(t) for t in texts]


def test_equal_ratios_go_to_the_first():
    assert greatest([]) is None
    assert greatest([(5, 30, 3), (9, 60, 6), (40, 31, 4)]) == (5, 30, 3)
    assert greatest([(5, 30, 10), (9, 61, 6)]) == (9, 61, 6)


def test_rows_equal_brute_force(spark):
    rng = random.Random(8)
    rows = corpus(4)
    for i in range(200):
        words = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 260))]
        rows.append((5000 + i, " ".join(words), None, None, None))
    rows += [(None, "x y " * 40, None, None, None), (None, None, None, None, None), rows[-1], rows[3], rows[3]]
    rows.append((77, " ".join(str(i % 977) for i in range(60_000)), None, None, None))
    df = docs(spark, rows)
    for c in ("n_runs", "start", "length", "period", "runs", "best", "kept", "seed"):
        df = df.withColumn(c, F.lit("clash"))
    got, expected = result(df), brute(rows[:-1])
    assert [r for r in got if r[0] != 77] == expected
    assert [r[1:6] for r in got if r[0] == 77] == [(1, 0, 60_000, 977, 61412)]
    assert sum(r[1] > 0 for r in got) > 15


def test_without_seed_or_rows(spark):
    r = collapse_runs(docs(spark, [(10, "a b c " * 9 + "d", None, None, None)])).first()
    assert (r.n_words, r.best.asDict(), r.kept) == (28, {"start": 0, "length": 27, "period": 3}, "a b c d")
    assert collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0
