"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from gazette.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def runs_of(w, exponent, least):
    """By definition: every period, every stretch whose letters repeat after it; of equal stretches the smallest period."""
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= 2 * p:
                best.setdefault((s, i + p), p)
            i += i == s
    return sorted(((s, e - s, p) for (s, e), p in best.items() if e - s >= max(least, exponent * p)), key=lambda r: (r[0], r[2]))


def flat(texts):
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    return np.concatenate([np.array(t, np.int64) + 100 * i for i, t in enumerate(texts)]), bounds


def test_runs_against_brute_force():
    rng, seen = random.Random(1), 0
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 60))]
            if len(w) > 4 and rng.random() < 0.5:  # repeats in repeats
                cycle = w[: rng.randint(1, len(w) // 2)]
                w = w[: rng.randrange(len(w))] + cycle * rng.randint(1, 5) + w[: rng.randrange(len(w))]
                w = w + w if rng.random() < 0.3 else w
            texts.append(w)
        for exponent, least in ((2, 2), (4, 6), (3, 1)):
            want = [runs_of(t, exponent, least) for t in texts]
            assert periodic_runs.find_runs(*flat(texts), exponent, least) == want
            seen += sum(map(len, want))
    assert seen > 5000


def test_factors_and_common_stretches():
    rng = random.Random(2)
    w = [rng.randrange(2) for _ in range(150)] + [0, 1] * 30
    ranks = periodic_runs.suffix_ranks(np.array(w))
    assert sorted(range(len(w)), key=lambda i: w[i:]) == np.argsort(ranks[-1][:-1]).tolist()
    ahead = lambda i, j: next((k for k in range(len(w) - max(i, j)) if w[i + k] != w[j + k]), len(w) - max(i, j))
    longest, source = periodic_runs.previous_factors(ranks)
    for i in range(len(w)):
        assert longest[i] == max((ahead(i, j) for j in range(i)), default=0)
        assert longest[i] == 0 or source[i] < i and ahead(i, source[i]) == longest[i]
    i, j = np.array([0, 5, 149]), np.array([7, 2, 151])
    back = [next((k for k in range(min(a, b) + 1) if w[a - k] != w[b - k]), min(a, b) + 1) for a, b in zip(i, j)]
    assert periodic_runs.common_before(ranks, i, j).tolist() == back


def test_long_periodic_text_and_small_chunks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 64)
    w = list(range(50)) + list(range(60, 67)) * 40
    assert periodic_runs.find_runs(*flat([w, w[:30] * 9]), 4, 6) == [[(50, 280, 7)], [(0, 270, 30)]]
    monkeypatch.undo()
    assert periodic_runs.find_runs(*flat([[1] * 200_000, [3, 4] * 100_000]), 4, 6) == [[(0, 200_000, 1)], [(0, 200_000, 2)]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    ids = {}
    runs = runs_of([ids.setdefault(w, len(ids)) for w in words], 4, 6)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *told, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    assert got == {expected(r.doc_id, r.text) for r in rows} and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "x y " * 8), (4, "x y " * 8), (20, "b c " * 50_000), (5, "z" * 5000)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, start long, period long")
    got = sorted((tuple(r) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    known = {t: expected(3, t) for i, t in rows if i != 20}  # 3 is not planted in
    assert [r for r in got if r[0] != 20] == sorted(((i, *known[t][1:]) for i, t in rows if i != 20), key=str)
    assert [r[1:6] for r in got if r[0] == 20] == [(1, 0, 100_000, 2, 50_000_000)]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
