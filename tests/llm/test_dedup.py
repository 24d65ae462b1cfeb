"""Exact and near deduplication against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.exact_dedup import drop_exact, exact_groups, golomb_decode, golomb_encode
from palimpsest.llm.simhash import components, covering_masks, fingerprint, near_groups, near_links

SCHEMA = "doc_id long, text string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**60), max_size=200), st.integers(0, 63))
def test_golomb_round_trip(values, k):
    v = np.unique(np.array(values, dtype=np.uint64))
    k = max(k, int(v.max()).bit_length() - 12) if len(v) else k
    assert (golomb_decode(golomb_encode(v, k), len(v), k) == v).all()


def edge_rows():
    long = "lorem ipsum dolor " * 3000
    texts = [None, "", "a", "A", "a", "É", "é", long, long.upper(), "x\n", "x", None, "the same"] + ["hot Copy"] * 40 + ["HOT copy"] * 40
    rows = list(enumerate(texts))
    return [*rows, rows[12], (None, "null id"), (None, "null id"), (None, "a")]


def test_exact_groups_edges(spark):
    rows = edge_rows()
    got = exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    by = {}
    for i, t in rows:
        by.setdefault(low(t), []).append(i)
    want = []
    for i, t in rows:
        ids = by[low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_groups(empty).count() == near_groups(empty).count() == 0


def test_drop_keeps_columns_and_order_of_names(spark):
    df = spark.createDataFrame([(1, "Aa", "k", 5), (2, "aA", "k", 6), (3, "b", None, 7)], "doc_id long, text string, fp string, sha int")
    out = drop_exact(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]


def plain_fingerprint(text, width=3):
    import xxhash

    words = low(text).split(" ")
    words = [w for w in low(text).replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    rng = np.random.default_rng(1)
    for free in ((1 << 64) - 1, 0xFFFF00FF00FF, 0x3FF):
        masks, places = covering_masks(free), [i for i in range(64) if free >> i & 1]
        for _ in range(300):
            diff = sum(1 << int(p) for p in rng.choice(places, size=int(rng.integers(1, 4)), replace=False))
            assert any(not m & diff for m in masks)
        assert len(masks) == 15 and all(m & ~free == 0 for m in masks)
    masks = covering_masks((1 << 64) - 1, 11, 3)
    for _ in range(500):
        diff = sum(1 << int(p) for p in rng.choice(64, size=int(rng.integers(1, 12)), replace=False))
        assert any(not m & diff for m in masks)
    assert len(masks) == 45


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("bucket", [8192, 64])
def test_links_connect_as_brute_force(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for x in base for _ in range(6)]
    dense = [int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    fps = sorted({*near, *dense, *map(int, base)})
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    root = {r.node & (1 << 64) - 1: r.root for r in components(near_links(df, bucket=bucket)).collect()}
    groups = {}
    for x, w in zip(fps, want):
        groups.setdefault(w, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_groups_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(100000, None), (100001, ""), (100002, "one"), (100003, "ONE"), (100004, "zwei drei")], SCHEMA)
    rows = docs.unionByName(extra)
    data = sorted(map(tuple, rows.collect()))
    fps = [plain_fingerprint(t) for _, t in data]
    root = union(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = sorted((d, f"{f:016x}", data[r][0]) for (d, _), f, r in zip(data, fps, root))
    assert sorted(map(tuple, near_groups(rows).collect())) == want


def test_fingerprint_shingles():
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("A b\tc\x0bd") == plain_fingerprint("a b c d")


def test_drop_exact_drops_rows_not_ids(spark):
    rows = [(5, "same", 1), (9, "SAME", 2), (5, "unique text B", 3), (7, "x", 4), (7, "X", 5), (None, "n", 6), (None, "n", 7), (None, "x", 8), (4, None, 9), (6, "", 10)]
    out = drop_exact(spark.createDataFrame(rows, SCHEMA + ", xx int").repartition(3))
    assert out.columns == ["doc_id", "text", "xx"]
    got = sorted(((r.doc_id, low(r.text)) for r in out.collect()), key=repr)
    assert got == sorted([(9, "same"), (5, "unique text b"), (7, "x"), (None, "n"), (6, "")], key=repr)
    assert drop_exact(spark.createDataFrame([], SCHEMA)).count() == 0
