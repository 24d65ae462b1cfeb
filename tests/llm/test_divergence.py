"""Source divergences against plain counting in Python's integers, and the slices' hashes against the library."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from palimpsest.llm import divergence as D
from palimpsest.llm.queries import ORACLES, op12_source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def by_hand(rows, least):
    docs = [tuple(x or "" for x in r[1:4]) for r in rows]
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    times, within = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall(low(text))
        times[lang, source].update(found)
        within[lang].update(set(found))
    out = []
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in within[lang].items() if n >= least]
        sources = {s for x, s in times if x == lang}
        total = {s: sum(times[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(times[lang, s][t], total[s], len(kept)) for t in kept} for s in sources}
        q = {t: share(sum(times[lang, s][t] for s in sources), sum(total.values()), len(kept)) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            above = [(q[t] - p[s][t], t.encode()) for t in kept if times[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(above)[:50])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_hashes_as_the_library():
    rng = np.random.default_rng(1)
    parts = [rng.bytes(k) for k in [*range(1, 70)] * 3]
    data, lengths = np.frombuffer(b"".join(parts) + bytes(8), dtype=np.uint8), np.array([len(p) for p in parts])
    assert D.slice_hashes(data, np.cumsum(lengths) - lengths, lengths).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_equal_hashes_of_different_bytes_stay_apart(monkeypatch):
    words = [b"one", b"two", b"one", b"three", b"thred", b"two", b"threeandmuchmore" * 3, b"threeandmuchmore" * 3, b"threeandmuchmorf" * 3]
    data, lengths = np.frombuffer(b"".join(words) + bytes(8), dtype=np.uint8), np.array([len(w) for w in words])
    monkeypatch.setattr(D, "slice_hashes", lambda d, s, n: n.astype(np.uint64) // 2)
    first, group = D.grouped(data, np.cumsum(lengths) - lengths, lengths)
    assert [words[first[g]] for g in group] == words and len(first) == len(set(words))


def test_terms_end_with_their_text():
    texts = pa.array(["ab", "", "Cd-e", "\u00c9t\u00e9\u4e00x1y", "\x7f@[`{", "z"], pa.large_string()).slice(1)
    words, group, term, n, docs = D.counted(texts, np.array([0, 0, 1, 1, 1]))
    got = {(g, words[t].decode()): (a, b) for g, t, a, b in zip(group.tolist(), term.tolist(), n.tolist(), docs.tolist(), strict=True)}
    assert got == {(0, "cd"): (1, 1), (0, "e"): (1, 1), (1, "\u00c9t\u00e9\u4e00x"): (1, 1), (1, "y"): (1, 1), (1, "z"): (1, 1)}


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    total = rng.integers(1, 280_000_000_000_000, 2000)
    n = np.minimum(rng.integers(0, 280_000_000_000_000, 2000), total - 5).clip(0)
    assert D.share(n, total).tolist() == [1 + 10**9 * (int(a) + 5) // int(b) for a, b in zip(n, total, strict=True)]


@pytest.mark.parametrize("block", [D.BLOCK, 7])
def test_audit_as_by_hand(spark, block):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "gamma", "\u00e9t\u00e9", "\u00c9t\u00e9", "w" * 40, "rare", "x1y", "\u4e00\u4e8c", "\U0001f600"] + [f"{a}{b}" for a in "abcdefgh" for b in "stuvwxyz"]
    rows = []
    for i in range(400):
        text = " ".join(words[int(k)] for k in rng.zipf(1.4, rng.integers(0, 30)) % len(words))
        rows.append((i, text, ["en", "de", None, ""][int(rng.integers(0, 4))], [f"s{int(rng.integers(0, 5))}", None, "hot"][int(rng.integers(0, 3))]))
    rows += [(500, None, "lonely", "s"), (501, "", "two", "b"), (502, "word", "two", "a"), rows[0], rows[0], (None, "alpha beta", "en", "hot"), (503, "beta " * 50_000, "de", "s0")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", term string").repartition(5)
    assert rows_of(D.audit(docs, least=10, block=block)) == by_hand(rows, 10)


def test_empty_table(spark):
    assert rows_of(D.audit(spark.createDataFrame([], SCHEMA))) == []


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duckdb.sql(ORACLES["op12_source_divergence"]).fetchall()
    assert rows_of(op12_source_divergence(spark, folder)) == sorted(want)
