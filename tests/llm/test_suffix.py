"""Repeats across documents against brute force."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.suffix_dedup import BLOCK, CHUNK, MAX_SEGMENT, cut_repeats, suffix_classes

SCHEMA = "doc_id long, text string"


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - 49):
                k = b[i : i + 50]
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=4, max_size=12).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=12), st.integers(2, 4), st.sampled_from([1, 3, 7, 1 << 18]))
def test_suffix_classes(parts, length, buffer):
    wide = np.zeros((len(parts), MAX_SEGMENT), dtype=np.uint8)
    for row, p in zip(wide, parts):
        row[: len(p)] = np.frombuffer(p, np.uint8)
    seg, size, classes = suffix_classes(wide, np.array([len(p) for p in parts]), length, buffer=buffer)
    head = [parts[s][len(parts[s]) - n :][:length] for s, n in zip(seg, size)]
    assert len(head) == sum(len(p) - length + 1 for p in parts)
    by = {}
    for h, c in zip(head, classes.tolist()):
        by.setdefault(h, set()).add(c)
    assert all(len(c) == 1 for c in by.values()) and len({next(iter(c)) for c in by.values()}) == len(by)


def test_edges(spark):
    p, q = "".join(f"passage {i} " for i in range(20)), "ünïcödé " * 30
    rows = [(1, None), (2, ""), (3, p), (4, "lead " + p + " tail"), (5, p), (6, q), (7, q + "x"), (8, p[:50]), (9, p[:49]), (10, p[:49]), (None, p), (None, p), (11, "it " * 400), (12, "it " * 300), (13, "x" * 60 + p[10:80] + p[5:70]), (3, "other " + p), (14, "a" * 49), (14, p)]
    rows += [(100 + i, f"{i} begins. " + p[20:150] + f" and ends {i * i}") for i in range(60)]
    assert sorted(map(repr, map(tuple, cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))) == brute(rows)
    assert cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert sorted(map(repr, map(tuple, cut_repeats(docs.repartition(5)).collect()))) == brute([tuple(r) for r in docs.collect()])


def test_several_blocks_and_extra_columns(spark):
    """One partition of more than two blocks of long periodic texts, some of which share their period; columns of other names stay out."""
    periods = [" ".join(f"{i} {j * j + i}" for j in range(90)) + " " for i in range(9)]
    rows = [(i, (periods[i % 9] + str(i % 12)) * (250_000 // len(periods[i % 9]))) for i in range(24)]
    assert sum(len(t) for _, t in rows) > 2 * BLOCK
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA + ", block string, data string, owner int, sha int").coalesce(1)
    assert sorted(map(repr, map(tuple, cut_repeats(docs).collect()))) == brute(rows)


def test_common_phrase(spark):
    """More contexts of one phrase than a chunk has segments; a few contexts come twice."""
    rows = [(i, f"{i % (CHUNK + 300):08d} a phrase that every one of them holds {(i % (CHUNK + 300)) * 7919:010d} and its end") for i in range(CHUNK + 400)]
    rows = [(d, t + ("" if d < CHUNK + 300 else " x")) for d, t in rows]
    assert sorted(map(repr, map(tuple, cut_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))) == brute(rows)
