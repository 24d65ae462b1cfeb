"""Chains of versions against following the links one by one."""

import numpy as np
import pytest

from palimpsest.operators.frames import numbered
from palimpsest.operators.supersession import chains


def followed(links):
    out = {}
    for k in links:
        at, depth, seen = k, 0, set()
        while links.get(at) in links and at not in seen:
            seen.add(at)
            at, depth = links[at], depth + 1
        out[k] = (None, None, True) if at in seen else (at, depth, False)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    links = {int(k): None if rng.random() < 0.1 else int(rng.integers(0, 130)) for k in range(120)} | {200: 200, 201: 200, 300: 999} | {400 + i: 401 + i for i in range(50)}
    got = chains(spark.createDataFrame(list(links.items()), "k long, s long").repartition(3), "k", "s").collect()
    assert {r.k: (r["head"], r.depth, r.cyclic) for r in got} == followed(links) and len(got) == len(links)


def test_no_links(spark):
    assert chains(spark.createDataFrame([], "k long, s long"), "k", "s").collect() == []
    assert [tuple(r) for r in chains(spark.createDataFrame([("a", None)], "k string, s string"), "k", "s").collect()] == [("a", "a", 0, False)]


def test_places_in_an_order(spark):
    rows = numbered(spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v").repartition(7), "n", "v").collect()
    assert all(r.n == r.v + 1 for r in rows) and len(rows) == 1000
