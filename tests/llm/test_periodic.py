import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from splatarium.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """All runs from their definition: every start, every period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out[i, length] = q
            i = j
    return sorted((s, size, q) for (s, size), q in out.items())


def brute_planted(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def brute_row(doc_id, text):
    words = brute_planted(doc_id, text)
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words))


@pytest.mark.parametrize("kinds", [1, 2, 3, 5, 30])
def test_runs_against_brute_force(kinds):
    rng = random.Random(kinds)
    for _ in range(400):
        ids, n = [], rng.randrange(0, 150)
        while len(ids) < n:
            unit = [rng.randrange(kinds) for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 13, 20]))]
            ids += unit * rng.choice([1, 1, 1, 3, 4, 5, 9]) + unit[: rng.randrange(len(unit) + 1)]
        assert periodic.runs_of(np.array(ids[:n], np.int64)) == brute_runs(ids[:n]), ids[:n]


def test_long_runs():
    # runs of all sizes behind one another, the hot one cut out of later lags
    unit = list(range(100, 137))
    ids = np.array([7] * 200_000 + list(range(1000, 1600)) * 40 + unit * 900 + [7, 8] * 50_000 + [5], np.int64)
    got = periodic.runs_of(ids)
    assert got == [(0, 200_000, 1), (200_000, 24_000, 600), (224_000, 33_300, 37), (257_300, 100_000, 2)]
    rng = np.random.default_rng(1)
    assert not [r for r in periodic.runs_of(rng.integers(0, 5000, 300_000)) if r[2] > 3]


def test_collapse(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "a a a a a a b", None), (4, "a a a a a a b", None), (5, "É ö É ö\tÉ\nö É ö   z", "x"), (6, "word " * 50_000, "x"), (None, "a b c a b c a b c a b d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(map(tuple, periodic.collapse(df).collect()), key=str)
    assert [r[:2] for r in got] == sorted(((i, t) for i, t, _ in rows), key=str)
    by = {r[0]: r[2:] for r in got}
    assert by[1] == by[2] == by[3] == (0, [], "")
    assert by[4] == (7, [(0, 6, 1)], "a b")
    assert by[5] == (10, [(0, 8, 2)], "É ö   z")
    assert by[6] == (50_000, [(0, 50_000, 1)], "word")
    assert by[None] == (12, [], "a b c a b c a b c a b d")
    assert periodic.collapse(df.filter("false")).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in periodic.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 12_000}
    assert {k: got[k] for k in want} == want and len(got) == docs.count()
    assert sum(1 for r in want.values() if r[0]) > 10


def test_query_on_odd_rows(spark, tmp_path):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(i, t) for i, t in zip(ids, [None, "", "one", "a b", "a b c", "x " * 30, "a b c d e f g h i j k l m n", " ".join(map(str, range(500)))] + ["q w e r t y"] * 4)] + [(None, "a b c d e f g"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *brute_row(i, t)) for i, t in rows), key=str)
