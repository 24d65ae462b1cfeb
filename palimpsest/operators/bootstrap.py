"""Percentile intervals of means by an exact bootstrap: in each round as many rows as there are are drawn with equal chance, with replacement.

A key's rows are dealt into chunks. How many of a round's n draws fall on a chunk is found by halving: of the draws on some chunks the first
half of these gets a binomial share by its number of rows, and so on down to one chunk. The generator of each halving is seeded by the
key, the round's seed and the place, so every chunk finds its own share without any other's data, and the shares of a round add up to
n. Within a chunk its draws fall on its rows alike. So each round is one multinomial draw over all rows, and no group is in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.frames import importable

#: Rows of a chunk on average; up to KINDS different values are drawn by value instead of row by row, which is the same.
CHUNK, KINDS = 50_000, 64


def share(sizes: np.ndarray, chunk: int, rounds: int, seed: tuple) -> np.ndarray:
    """How many of sum(sizes) draws fall on a chunk in each round."""
    before = np.concatenate(([0], np.cumsum(sizes)))
    low, high = 0, len(sizes)
    draws = np.full(rounds, before[-1], dtype=np.int64)
    while high - low > 1:
        half = (low + high) // 2
        rows = before[high] - before[low]
        first = np.random.default_rng([*seed, low, high]).binomial(draws, (before[half] - before[low]) / rows if rows else 0.0)
        low, high, draws = (low, half, first) if chunk < half else (half, high, draws - first)
    return draws


def sums(x: np.ndarray, draws: np.ndarray, seed: tuple) -> np.ndarray:
    """The sum of draws[b] values drawn from x for each round b; x in a fixed order."""
    if not len(x):
        return np.zeros(len(draws))
    rng = np.random.default_rng([*seed, 1])
    kinds, n = np.unique(x, return_counts=True)
    if len(kinds) <= KINDS:
        return rng.multinomial(draws, n / len(x)) @ kinds
    return np.array([x[rng.integers(0, len(x), d)].sum() for d in draws.tolist()])


def rounds_of(rows: DataFrame, row: str, key: str, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """key, round, n (draws) and s (their sum) by round and key; rows with a null value play no part, a null key is a key. `row` tells rows of a key apart."""
    importable(rows.sparkSession)
    known = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(row).alias("h"), F.col(value).cast("double").alias("x"))
    chunks = known.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    few = F.broadcast(chunks) if chunks.count() <= 100_000 else chunks
    placed = known.alias("a").join(few.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k"))).select("a.k", "h", "x", "chunks", F.pmod("h", "chunks").cast("int").alias("chunk"))
    per = placed.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("m"), F.first("chunks").alias("chunks"))
    lists = per.groupBy("k").agg(F.first("chunks").alias("n"), F.map_from_entries(F.collect_list(F.struct("chunk", "m"))).alias("at"))  # a number for each chunk of a key
    sizes = lists.select("k", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.coalesce(F.try_element_at("at", c), F.lit(0))).alias("sizes"))
    told = per.alias("p").join(sizes.alias("s"), F.col("p.k").eqNullSafe(F.col("s.k"))).select(F.col("p.k").alias("k2"), F.col("p.chunk").alias("chunk2"), "sizes")
    kind = dict(rows.dtypes)[key]

    def run(group: tuple, values: pa.Table, told: pa.Table) -> pa.Table:
        k, chunk = group[0].as_py(), group[1].as_py()
        values = values.sort_by([("h", "ascending"), ("x", "ascending")])
        own = (seed, zlib.crc32(repr(k).encode()))
        draws = share(told.column("sizes")[0].values.to_numpy(zero_copy_only=False), chunk, rounds, own)
        s = sums(values.column("x").to_numpy(), draws, (*own, chunk))
        return pa.table({"k": pa.array([k] * rounds, values.column("k").type), "round": pa.array(np.arange(rounds), pa.int32()), "n": pa.array(draws), "s": pa.array(s, pa.float64())})

    parts = placed.select("k", "chunk", "h", "x").groupBy("k", "chunk").cogroup(told.groupBy("k2", "chunk2")).applyInArrow(lambda g, a, b: run(g, a, b), f"k {kind}, round int, n long, s double")
    return parts.groupBy(F.col("k").alias(key), "round").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def interval(rows: DataFrame, row: str, key: str, value: str, rounds: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """key, lo and hi: the percentile interval of the mean of value by key."""
    means = rounds_of(rows, row, key, value, rounds, seed).groupBy(key).agg(F.array_sort(F.collect_list(F.round(F.col("s") / F.col("n"), 9))).alias("m"))  # a number for each round
    return means.select(key, F.element_at("m", int(alpha / 2 * rounds) + 1).alias("lo"), F.element_at("m", int((1 - alpha / 2) * rounds)).alias("hi"))
