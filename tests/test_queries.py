"""Every registered query of the library proper against its SQL."""

import duckdb
import pytest

from palimpsest.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_bootstrap_brackets_the_mean(spark, sf):
    ci = {r.domain: (r.lo, r.hi) for r in catalog.QUERIES["agg07_bootstrap_ci"](spark, sf).collect()}
    for r in catalog.QUERIES["agg02_facets_grouping_sets"](spark, sf).where("domain is not null").collect():
        assert ci[r.domain][0] <= r.success <= ci[r.domain][1]
