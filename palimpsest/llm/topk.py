"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are packed into blocks of BLOCK rows. For a block and a query, each dimension has a list of the block's rows sorted by
value, read from the top if the query is positive there and from the bottom if negative. Rounds of sorted access score every
row they meet; the bound of what is unseen is the query's product with the values the lists have come to. The search of a
block ends when that bound is below the k-th best score so far, which a task carries from block to block.

Queries reach the blocks packed too: broadcast while their size is proven small, else by a shuffle in which each part of the
blocks gets all packs. Each task passes on k rows
a query at most, and a window picks the best of them.

Defined results: vectors that are null or hold null or non-finite components take no part; components are floor(256 x); ties
go to the smaller vec_id; the query's own vec_id is no candidate, repeated vec_ids are candidates of their own, and queries
repeated under one vec_id are one query; vectors of another length than a query's take no part in it; null ids take no part;
an empty table gives no rows. Scores are exact while they fit in 53 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._shared import BROADCAST_BYTES, ready, stored

K, BLOCK, QUERIES, STEP, SCALE = 5, 2048, 256, 16, 256


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, held = TaskContext.get().partitionId() << 33, 0, {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal n
            ids, vectors = zip(*held.pop(dim), strict=True)
            n += 1
            cols = [[base + n], [dim], [np.array(ids, "<i8").tobytes()], [np.array(vectors, "<f8").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "dim", "ids", "vectors"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def threshold_search(ids: np.ndarray, vectors: np.ndarray, lists: np.ndarray, query_id: int, query: np.ndarray, best: list[tuple[float, int]], k: int, step: int = STEP) -> list[tuple[float, int]]:
    """The k best (score, id), from best and from the block; lists[d] has the rows in ascending order of dimension d."""
    n, used = len(ids), np.flatnonzero(query)
    if not len(used):
        used = np.arange(1)
    falling = query[used] > 0
    seen = np.zeros(n, dtype=bool)
    at = 0
    while at < n:
        to = min(n, at + step)
        met = np.concatenate((lists[used[falling], n - to : n - at].ravel(), lists[used[~falling], at:to].ravel()))
        new = np.zeros(n, dtype=bool)
        new[met] = True
        new &= ~seen
        seen |= new
        rows = np.flatnonzero(new)
        if len(rows):
            scores = vectors[rows] @ query
            if len(best) == k:
                rows, scores = rows[scores >= best[-1][0]], scores[scores >= best[-1][0]]
            rows, scores = rows[ids[rows] != query_id], scores[ids[rows] != query_id]
            best = sorted([*best, *zip(scores.tolist(), ids[rows].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        edge = np.where(falling, vectors[lists[used, n - to], used], vectors[lists[used, to - 1], used])
        if len(best) == k and edge @ query[used] < best[-1][0]:
            break
        at, step = to, step * 2
    return best


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        last, lists = None, None
        for b in batches:
            for r in range(b.num_rows):
                block, dim, ids, vectors, q_ids, q = (b.column(i)[r].as_py() for i in range(6))
                ids, vectors = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, dim)
                if block != last:
                    last, lists = block, np.argsort(vectors, axis=0, kind="stable").T.copy()
                for i, v in zip(np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q, "<f8").reshape(-1, dim), strict=True):
                    best[i] = threshold_search(ids, vectors, lists, i, v, best.get(i, []), k)
        flat = [(q, i, int(s)) for q, found in best.items() for s, i in found]
        for at in range(0, len(flat), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat[at : at + 10_000], strict=True)], names=["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k best of vectors (both with columns vec_id, embedding)."""
    spark = vectors.sparkSession
    ready(spark, 512)

    def clean(df: DataFrame) -> DataFrame:
        x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("double"))
        good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
        return df.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).select("vec_id", x.alias("x"))

    packed = "block long, dim int, ids binary, vectors binary"
    asked = stored(
        clean(queries).groupBy("vec_id").agg(F.min("x").alias("x")).mapInArrow(_blocks(QUERIES), packed)
        .select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q")),
        "queries",
    )
    blocks = clean(vectors).mapInArrow(_blocks(block), packed)
    size = asked.agg(F.sum(F.length("q"))).first()[0] or 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    if size <= BROADCAST_BYTES:
        pairs = blocks.join(F.broadcast(asked), F.col("dim") == F.col("q_dim"))
    else:  # packs meet the blocks of each of some parts, as one dimension alone would be one task
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = asked.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = blocks.withColumn("part", F.expr(f"cast(pmod(xxhash64(block), {parts}) as int)")).join(spread, (F.col("dim") == F.col("q_dim")) & (F.col("part") == F.col("q_part")))
    found = pairs.select("block", "dim", "ids", "vectors", "q_ids", "q").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
