"""The exact bootstrap: draws add up, seeds fix the result, intervals lie where one generator's do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import bootstrap as B


def test_shares_add_up_and_are_multinomial():
    sizes = np.array([5, 0, 17, 3, 40, 1, 9])
    shares = np.array([B.share(sizes, c, 20_000, (1, 2)) for c in range(len(sizes))])
    n, p = sizes.sum(), sizes / sizes.sum()
    assert (shares.sum(0) == n).all() and (shares[1] == 0).all()
    assert np.allclose(shares.mean(1), n * p, atol=0.15)
    want = n * (np.diag(p) - np.outer(p, p))
    assert np.allclose(np.cov(shares), want, atol=0.6)


def test_values_by_kind_or_by_row():
    rng = np.random.default_rng(3)
    few, many = rng.integers(0, 2, 400).astype(float), rng.normal(size=400)
    for x in (few, many):
        s = B.sums(x, np.full(4000, 400), (5,))
        assert abs(s.mean() / 400 - x.mean()) < 0.005 and abs(s.std() / 400 - x.std() / 20) < 0.003
    assert (B.sums(np.zeros(0), np.zeros(3, dtype=int), (1,)) == 0).all()


@pytest.mark.parametrize("chunk", [B.CHUNK, 37])
def test_intervals(spark, monkeypatch, chunk):
    monkeypatch.setattr(B, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "hot", None][int(k)], float(v)) for i, (k, v) in enumerate(zip(rng.choice(3, 1500, p=[0.2, 0.7, 0.1]), rng.normal(5, 2, 1500), strict=True))] + [(9000, "a", None), (9001, "one", 3.0)]
    df = spark.createDataFrame(rows, "id long, k string, v double").repartition(4)
    sums = B.rounds_of(df, "id", "k", "v").cache()
    count = {k: sum(x[1] == k and x[2] is not None for x in rows) for k in ("a", "hot", None, "one")}
    assert {(r.k, r.n) for r in sums.select("k", "n").distinct().collect()} == set(count.items()) and sums.count() == 4000
    got = {r.k: (r.lo, r.hi) for r in B.interval(df, "id", "k", "v").collect()}
    assert got == {r.k: (r.lo, r.hi) for r in B.interval(df.repartition(7), "id", "k", "v").collect()}
    assert got != {r.k: (r.lo, r.hi) for r in B.interval(df, "id", "k", "v", seed=43).collect()}
    assert got["one"] == (3.0, 3.0)
    for k in ("a", "hot", None):
        x = np.array([v for _, g, v in rows if g == k and v is not None])
        m = np.sort(np.random.default_rng(5).choice(x, (1000, len(x))).mean(1))
        error = 4 * x.std() / len(x) ** 0.5 * 0.08
        assert abs(got[k][0] - m[25]) < error and abs(got[k][1] - m[974]) < error
    sums.unpersist()


def test_no_rows(spark):
    assert B.interval(spark.createDataFrame([], "id long, k string, v double").withColumn("w", F.lit(1)), "id", "k", "v").collect() == []
