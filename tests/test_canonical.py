"""Canonical JSON against Python's json, on nested rows made at random."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.canonical import canonical

KIND = "struct<z:string,a:bigint,list:array<struct<t:string,x:double,b:boolean>>,m:map<string,array<double>>,s:struct<q:string,`odd \"name`:int>,when:timestamp_ntz,day:date>"


def dumps(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)


text = st.text(st.characters(codec="utf-8"), max_size=8)
double = st.floats(width=64)
value = st.fixed_dictionaries({
    "z": st.none() | text, "a": st.none() | st.integers(-(2**63), 2**63 - 1), "list": st.none() | st.lists(st.fixed_dictionaries({"t": text, "x": st.none() | double, "b": st.booleans()}), max_size=3),
    "m": st.none() | st.dictionaries(text, st.lists(double, max_size=2), max_size=3), "s": st.none() | st.fixed_dictionaries({"q": text, 'odd "name': st.integers(0, 9)}),
    "when": st.none() | st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2050, 1, 1)), "day": st.none() | st.dates(dt.date(1950, 1, 1), dt.date(2050, 1, 1)),
})


def test_rows_at_random(spark):
    rows = []

    @settings(max_examples=300, database=None, deadline=None)
    @given(value)
    def gather(v):
        rows.append(v)

    gather()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {KIND}")
    got = {r.i: r.c for r in df.select("i", canonical(F.col("v"), df.schema["v"].dataType).alias("c")).collect()}
    for i, v in enumerate(rows):
        assert got[i] == dumps(v)


def test_doubles(spark):
    rng = np.random.default_rng(1)
    xs = [0.0, -0.0, 1.0, -1.5, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 0.00012345, 5e-324, 1.7976931348623157e308, 1e22, 1e23, 2.0**-44, 9007199254740993.0, 100.0, 1234567.0, 12345678.9, math.nan, math.inf, -math.inf]
    xs += [float(x) for x in rng.normal(size=400) * 10.0 ** rng.integers(-25, 25, 400)] + [float(x) for x in rng.integers(0, 10**15, 100) / 1000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.c for r in df.select("i", canonical(F.col("x"), T.DoubleType()).alias("c")).collect()}
    assert [got[i] for i in range(len(xs))] == [dumps(x) for x in xs]


def test_no_form():
    with pytest.raises(ValueError):
        canonical(F.col("x"), T.BinaryType())
