"""Keyword search through trigram lists against Python's `in` on every document."""

import numpy as np
import pytest

from palimpsest.operators import keyword_search as S


def test_lists_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        x = np.unique(rng.integers(0, 16_000, n))
        assert S.decoded(S.coded(x)).tolist() == x.tolist()
    assert S.coded(np.array([0, 1, 2, 130])) == b"\x00\x00\x00\x7f" and S.coded(np.array([128])) == b"\x80\x01"
    with pytest.raises(ValueError):
        S.coded(np.array([1 << 15]))


def brute(docs, queries, k):
    out = []
    for q, text in queries:
        words = (text or "").lower().split()
        scored = sorted((-sum(w in hay for w in words), i) for i, hay in docs)[:k] if words else []
        out += [(q, i, -n / len(words), r) for r, (n, i) in enumerate(scored, 1) if n]
    return sorted(out)


@pytest.mark.parametrize("block", [S.BLOCK, 16])
def test_as_looking_at_all(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(2)
    parts = ["alpha", "be", "c", "délta ", " ", "Epsilon", "policy@2.0", "x", "\n", "ligne"]
    make = lambda n: "".join(parts[i] for i in rng.integers(0, len(parts), n))
    docs = [(i, make(int(rng.integers(0, 12))), "s") for i in range(200)] + [(900, None, None), (901, "", "only"), (902, "word " * 20_000, "s")]
    queries = [(i, make(int(rng.integers(1, 6)))) for i in range(40)] + [(100, None), (101, "  "), (102, "nothinglikethis"), (103, "lpha alpha alpha zzz"), (104, "a"), (105, "s")]
    frame = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, q int").repartition(3)
    index = S.build(frame, "doc_id", "text", "source")
    hays = [(i, " ".join(x for x in (t, s) if x is not None).lower()) for i, t, s in docs]
    got = S.search(spark.createDataFrame(queries, "id long, text string"), "id", "text", index, 7).collect()
    assert sorted((r.q, r.doc_id, r.score, r.rank) for r in got) == brute(hays, queries, 7)
    assert S.search(spark.createDataFrame(queries[:0], "id long, text string"), "id", "text", index).collect() == []


def test_empty_index(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.search(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text", S.build(none, "doc_id", "text")).collect() == []
