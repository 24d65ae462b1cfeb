"""Periodic runs against a search by definition."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from palimpsest.llm import periodic_runs as P
from palimpsest.llm.queries import op11_periodic_runs

SCHEMA = "doc_id long, text string"


def runs_by_definition(words):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q):
                own = words[i : i + length]
                if not any(own[p:] == own[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def by_hand(doc_id, text, runs=runs_by_definition):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made(rng):
    """Words with repeats of repeats, cut and joined at random."""
    words = [str(int(w)) for w in rng.integers(0, rng.integers(1, 30), rng.integers(0, 12))]
    for _ in range(int(rng.integers(0, 5))):
        own = words[int(rng.integers(0, len(words) + 1)) :] or ["z"]
        times = int(rng.integers(1, 5))
        words = (words + own * times)[: int(rng.integers(1, 400))] + [str(int(w)) for w in rng.integers(0, 9, rng.integers(0, 4))]
    return words


def test_runs_by_definition():
    rng, some = np.random.default_rng(5), 0
    rows = [(i, " ".join(made(rng))) for i in range(1500)]
    got = P.scan_texts(*map(list, zip(*rows, strict=True)))
    want = [by_hand(*r) for r in rows]
    assert got == want
    assert sum(r[1] > 1 for r in want) > 300 and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 100


def test_frequent_and_rare_words_count_alike(monkeypatch):
    rng = np.random.default_rng(6)
    codes = [rng.zipf(1.5, k) % 50 for k in (700, 0, 1, 13, 2500, 40)]
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    want = [[0] + [int((c[q:] == c[:-q]).sum()) for q in range(1, len(c) // 2 + 1)] for c in codes]
    for limit in (0.0, 20.0, 1e9):
        monkeypatch.setattr(P, "frequent_from", lambda n, limit=limit: limit)
        assert [x.tolist() for x in P.pairs_by_lag(np.concatenate(codes), bounds)] == want


def test_long_periods_and_frequent_words():
    rng = np.random.default_rng(7)
    for n, q in ((9000, 3000), (9000, 4500), (20_000, 17), (6000, 1), (5000, 256)):
        own = rng.integers(0, 40, q)
        codes = np.concatenate((rng.integers(0, 40, 777), np.resize(own, n), rng.integers(0, 40, 500)))
        pairs = P.pairs_by_lag(codes, np.array([0, len(codes)]))[0]
        found = P.runs_of(codes, pairs)
        s, m, p = max(found, key=lambda r: r[1])
        assert p == q and m >= n and s <= 777
        words = codes.tolist()
        # A window's brute force agrees on what lies in it.
        if n <= 6000:
            assert [r for r in found] == runs_fast(words)


def runs_fast(words):
    """By definition too, over all lags, with arrays."""
    w, out = np.array(words), []
    for q in range(1, len(w) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (w[q:] == w[:-q]).astype(int), [0])))).reshape(-1, 2)
        for x, y in edge.tolist():
            if y - x + q >= max(12, 2 * q) and not any(np.array_equal(w[x : y + q - p], w[x + p : y + q]) for p in range(1, q)):
                out.append((x, y - x + q, q))
    return sorted(out)


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 11), (5, "a " * 12), (6, "a b " * 6), (7, "a\u00a0b " * 12), (None, "x y z " * 5), (8, "a b " * 6), (8, "a b " * 6), (9, "one two three"), (20, "w " * 40_000), (26, "p q r s " * 20)]


def test_edge_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 7, "x") for r in EDGE], SCHEMA + ", n_runs int, start string").repartition(3)
    got = sorted((tuple(r) for r in P.find_runs(docs).collect()), key=repr)
    fast = lambda words: [(0, len(words), 1)] if len(set(words)) == 1 and len(words) >= 12 else runs_by_definition(words)
    assert got == sorted((by_hand(*r, fast) for r in EDGE), key=repr)
    assert P.find_runs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_by_definition(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, folder).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert got[doc_id] == by_hand(doc_id, text, runs_fast)
