"""As-of joins against plain loops, with one key that holds most rows cut into ranges."""

import datetime as dt

import numpy as np
import pytest

from palimpsest.operators import asof as A

DAY = dt.datetime(2020, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(days=int(n))


def made(rng, n, span, hot):
    key = lambda: None if rng.random() < 0.03 else "hot" if rng.random() < hot else f"k{rng.integers(0, 6)}"
    left = [(i, key(), at(rng.integers(-5, span)) if rng.random() > 0.03 else None) for i in range(n)]
    windows = []
    for i in range(n):
        a = int(rng.integers(0, span))
        length = [0, int(rng.integers(1, 6)), int(rng.integers(1, span)), None][int(rng.choice(4, p=[0.05, 0.55, 0.35, 0.05]))]
        windows.append((key(), at(a) if rng.random() > 0.03 else None, None if length is None else at(a + length), i % 37))
    return left, windows


def frames(spark, left, windows):
    return (spark.createDataFrame(left, "id int, k string, t timestamp_ntz").repartition(3), spark.createDataFrame(windows, "k string, a timestamp_ntz, b timestamp_ntz, v int").repartition(3))


@pytest.mark.parametrize(("n", "span", "hot", "least"), [(0, 10, 0, 1000), (60, 20, 0.3, 1000), (400, 90, 0.6, 20), (400, 12, 0.6, 20), (700, 900, 1.0, 9)])
def test_last_start_and_windows_in_force(spark, monkeypatch, n, span, hot, least):
    monkeypatch.setattr(A, "LEAST", least)
    left, windows = made(np.random.default_rng(n + span), n, span, hot)
    a, b = frames(spark, left, windows)
    got = {r.id: r.v for r in A.asof(a, b, ["k"], "t", "a", ["v"]).collect()}
    want = {i: max(((s, v) for x, s, _, v in windows if x == k and k is not None and t is not None and s is not None and s <= t), default=(None, None))[1] for i, k, t in left}
    assert got == want
    got = {r.id: r.v for r in A.in_force(a, b, ["k"], "t", "a", "b", ["v"]).collect()}
    open_at = lambda s, e, t: t is not None and s is not None and s <= t and (e is None or t < e)
    want = {i: max(((s, v) for x, s, e, v in windows if x == k and k is not None and open_at(s, e, t)), default=(None, None))[1] for i, k, t in left}
    assert got == want


def test_a_hot_key_is_cut(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAST", 50)
    rows = spark.range(20_000).selectExpr("if(id % 10 < 7, 'hot', concat('k', id % 10)) as k", "id as t")
    cut = A.borders(rows, ["k"], "t")
    points = {r.k: r["_points"] for r in cut.collect()}
    limit = 20_000 // (4 * 4)
    sizes = A._ranged(rows, cut, ["k"], A.F.col("t")).groupBy("k", "_range").count().where("k = 'hot'").collect()
    assert "hot" in points and len(sizes) >= 11 and max(r["count"] for r in sizes) <= 1.2 * limit
    assert A.borders(rows.limit(40), ["k"], "t") is None


def test_several_keys_and_other_kinds(spark):
    a = spark.createDataFrame([(1, 1, 5.0, "x"), (1, 2, 5.0, "y"), (2, 1, 0.5, "z")], "p int, q int, t double, name string")
    b = spark.createDataFrame([(1, 1, 5.0, "five"), (1, 1, 4.0, "four"), (2, 1, 1.0, "late")], "p int, q int, s double, word string")
    got = {r.name: (r.p, r.word, r.s) for r in A.asof(a, b.withColumn("s2", A.F.col("s")), ["p", "q"], "t", "s2", ["word", "s"]).collect()}
    assert got == {"x": (1, "five", 5.0), "y": (1, None, None), "z": (2, None, None)}
