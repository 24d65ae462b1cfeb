"""The inverted file against comparing all vectors."""

import numpy as np
import pytest

from palimpsest.operators import vector_index as V

SCHEMA = "vec_id long, embedding array<float>, x int"


def brute(rows, asked, k, own):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in [r for r in ok if r[0] in asked]:
        s = sorted((-round(float(q @ v), 6) + 0.0, j) for j, v in ok if len(v) == len(q) and (own or j != i))[:k]
        out |= {(i, j, -x + 0.0, n + 1) for n, (x, j) in enumerate(s)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 12)) * 3
    f32 = lambda v: [float(np.float32(x)) for x in v]
    out = [(i, f32(centres[i % 9] + rng.normal(size=12) * 0.2)) for i in range(900)]
    out += [(1000 + i, f32(centres[0])) for i in range(500)]  # a third of all are alike
    out += [(2000 + i, f32(rng.normal(size=5))) for i in range(30)]
    return [*out, (3000, None), (3001, []), (3002, [1.0, None]), (3003, [float("nan")] * 12), (3004, [0.0] * 12), (None, [1.0] * 12)]


@pytest.mark.parametrize("limit", [V.BROADCAST_BYTES, 0])
@pytest.mark.parametrize(("k", "own"), [(1, True), (5, False), (40, False), (2000, True)])
def test_as_comparing_all(spark, monkeypatch, rows, limit, k, own):
    monkeypatch.setattr(V, "PACK", 64)
    monkeypatch.setattr(V, "ASKED", 16)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    index = V.build(df, cells=9)
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    touched = spark.sparkContext.accumulator(0)
    got = {(r.q, r.vec_id, r.score + 0.0, r.pool) for r in V.search(df.where("vec_id % 20 = 0"), index, k, own, touched, limit).collect()}
    assert got == brute(rows, asked, k, own)
    assert index.n == 1431 and max(len(r.ids) for r in index.packs.collect()) < 200
    if k <= 5:
        assert touched.value < 0.6 * len(asked) * index.n  # the rest are never looked at


def test_empty(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows[:50]], SCHEMA)
    none = df.limit(0)
    assert V.search(df, V.build(none), 3).collect() == []
    assert V.search(none, V.build(df), 3).collect() == []
