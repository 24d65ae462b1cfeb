"""An inverted file of vectors for exact search by inner product.

k-means cells are fitted to a bounded sample; every vector is stored under its nearest centre, in packs that know how far their vectors
are from it. No vector x of a pack of radius r around c scores more than q.c + |q| r, so a pack is passed over as soon as this cannot
beat the k-th hit that a query has already. What is found is what a comparison with all vectors finds.

Queries within a checked size are sent to all tasks, and the packs are read once. Beyond it each query first goes to its PROBES best
cells, and then, with the k-th score found there, to every other cell that can still beat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.frames import BROADCAST_BYTES, importable, stored

#: Vectors that cells are fitted to, cells at most, vectors of a pack on average, cells a query sees first, queries of a pack of queries.
SAMPLE, CELLS, PACK, PROBES, ASKED = 20_000, 1024, 512, 3, 512
#: Scores are compared as rounded to six digits; a bound must be short of a score by more than that.
DIGITS, SLACK = 6, 2e-6
HITS = "q long, vec_id long, score double"


@dataclass
class Model:
    """A dimension's centres (a row each), one vector near each (ids, rows) and each cell's radius."""

    centres: np.ndarray
    near_ids: np.ndarray
    near: np.ndarray
    radius: np.ndarray


@dataclass
class Index:
    """packs: dim, cell, radius, ids, values (vectors one after the other); models by dimension."""

    packs: DataFrame
    models: dict[int, Model]
    n: int


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", "embedding", F.size("embedding").alias("dim"))


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spread rows; an empty cell takes the row that is furthest from its centre."""
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
        cell = d.argmin(1)
        far = np.argsort(-(d[np.arange(len(x)), cell] + (x**2).sum(1)))
        for c in range(n):
            own = x[cell == c]
            centres[c] = own.mean(0) if len(own) else x[far[c % len(far)]]
    return centres


def build(vectors: DataFrame, cells: int | None = None) -> Index:
    """The index of all rows (vec_id, embedding); null ids and vectors with null or non-finite components take no part, repeated ids stay."""
    spark = vectors.sparkSession
    importable(spark)
    rows = _usable(vectors)
    sizes = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # a row for each dimension
    centres = {}
    for dim, n in sizes.items():
        some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id")).select("embedding").limit(SAMPLE).toPandas()
        x = np.array(some["embedding"].tolist(), dtype=np.float64)
        centres[dim] = _centres(x, min(len(x), cells or max(1, min(CELLS, int(n**0.5 / 2)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, dims = b.column("embedding"), b.column("dim").to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(np.float64)
                c = centres[dim]
                cell[at] = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                far[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=["vec_id", "embedding", "dim", "cell", "far"])

    kind = dict(rows.dtypes)["embedding"]
    placed = stored(rows.mapInArrow(assign, f"vec_id long, embedding {kind}, dim int, cell int, far double"), "placed")
    per = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.min_by(F.struct("vec_id", "embedding"), "far").alias("near"))
    models, found = {}, per.orderBy("dim", "cell").collect()  # CELLS rows at most for each dimension
    for dim in sizes:
        own = [r for r in found if r.dim == dim]
        radius = np.zeros(len(centres[dim]))
        radius[[r.cell for r in own]] = [r.radius for r in own]
        models[dim] = Model(centres[dim], np.array([r.near.vec_id for r in own]), np.array([r.near.embedding for r in own], dtype=np.float64), radius)
    packs = per.select("dim", "cell", F.ceil(F.col("n") / PACK).alias("packs"))
    dealt = placed.join(F.broadcast(packs), ["dim", "cell"]).withColumn("pack", F.pmod(F.xxhash64("vec_id", "far"), F.col("packs")))
    items = F.collect_list(F.struct("vec_id", "embedding")).alias("items")
    out = dealt.groupBy("dim", "cell", "pack").agg(items, F.max("far").alias("radius")).select("dim", "cell", "radius", F.col("items.vec_id").alias("ids"), F.flatten("items.embedding").alias("values"))
    return Index(stored(out, "packs"), models, sum(sizes.values()))


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row of score, ties to the smaller id; ids are those of each row or of all."""
    ids = np.broadcast_to(ids, score.shape)
    return np.lexsort((ids, -score), axis=1)[:, :k]


class Search:
    """Queries of one dimension with the best hits so far."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int, own: bool, model: Model, floor: np.ndarray | None = None):
        self.q_ids, self.q, self.k, self.own, self.model = q_ids, q, k, own, model
        self.norm, self.touched = np.sqrt((q**2).sum(1)), 0
        self.to_centre = q @ model.centres.T
        self.ids, self.score = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
        self.floor = np.full(len(q), -np.inf) if floor is None else floor

    def start(self) -> None:
        """Known scores of the vectors near the centres: the k-th of them is a score to beat."""
        score = self._scores(self.model.near_ids, self.model.near, slice(None))
        if score.shape[1] >= self.k:
            self.floor = np.maximum(self.floor, np.partition(score, -self.k, axis=1)[:, -self.k])

    def _scores(self, ids: np.ndarray, x: np.ndarray, rows) -> np.ndarray:  # noqa: ANN001
        score = np.round(self.q[rows] @ x.T, DIGITS)
        if not self.own:
            score[self.q_ids[rows][:, None] == ids[None, :]] = -np.inf
        return score

    def bounds(self, cell: int, radius: float) -> np.ndarray:
        return self.to_centre[:, cell] + self.norm * radius

    def take(self, cell: int, radius: float, ids: np.ndarray, x: np.ndarray) -> None:
        """Compare a pack with the queries whose k-th hit it can beat."""
        rows = np.flatnonzero(self.bounds(cell, radius) >= self.floor - SLACK)
        if not rows.size:
            return
        self.touched += len(rows) * len(ids)
        score = self._scores(ids, x, rows)
        if self.score.shape[1] < self.k:
            more = self.k - self.score.shape[1]
            self.ids = np.pad(self.ids, ((0, 0), (0, more)))
            self.score = np.pad(self.score, ((0, 0), (0, more)), constant_values=-np.inf)
        all_ids = np.concatenate((self.ids[rows], np.broadcast_to(ids, score.shape)), 1)
        score = np.concatenate((self.score[rows], score), 1)
        keep = best(all_ids, score, self.k)
        self.ids[rows], self.score[rows] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(score, keep, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows][:, -1])

    def hits(self) -> pa.RecordBatch:
        good = self.score > -np.inf
        cols = [np.broadcast_to(self.q_ids[:, None], self.score.shape)[good], self.ids[good], self.score[good]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "vec_id", "score"])


def _packs(b: pa.RecordBatch) -> Iterator[tuple[int, int, float, np.ndarray, np.ndarray]]:
    """Packs of a batch, tight ones first."""
    for r in np.argsort(b.column("radius").to_numpy(zero_copy_only=False), kind="stable").tolist():
        dim, ids = b.column("dim")[r].as_py(), b.column("ids")[r].values.to_numpy(zero_copy_only=False)
        yield dim, b.column("cell")[r].as_py(), b.column("radius")[r].as_py(), ids, b.column("values")[r].values.to_numpy(zero_copy_only=False).reshape(len(ids), dim).astype(np.float64)


def _read_once(index: Index, asked: list, k: int, own: bool, touched) -> DataFrame:  # noqa: ANN001
    sides = {d: [r for r in asked if r.dim == d] for d in {r.dim for r in asked} & set(index.models)}
    sides = {d: (np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)) for d, rows in sides.items()}
    sent = index.packs.sparkSession.sparkContext.broadcast((sides, {d: index.models[d] for d in sides}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, models = sent.value
        searches = {d: Search(ids, q, k, own, models[d]) for d, (ids, q) in sides.items()}
        for s in searches.values():
            s.start()
        for b in batches:
            for dim, *pack in _packs(b):
                if dim in searches:
                    searches[dim].take(*pack)
        for s in searches.values():
            if touched is not None:
                touched.add(s.touched)
            yield s.hits()

    return index.packs.mapInArrow(run, HITS)


def _wanted(queries: DataFrame, models: dict[int, Model], first: bool) -> DataFrame:
    """cell, dim, vec_id, embedding, floor: a query's PROBES best cells, or all others that can beat its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, floor = b.column("dim").to_numpy(zero_copy_only=False), b.column("floor").to_numpy(zero_copy_only=False)
            for dim in sorted(set(dims.tolist()) & set(models)):
                at, m = np.flatnonzero(dims == dim), models[dim]
                q = b.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim).astype(np.float64)
                bound = q @ m.centres.T + np.sqrt((q**2).sum(1))[:, None] * m.radius[None, :]
                order = np.argsort(-bound, axis=1, kind="stable")
                mine = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(mine, order[:, :PROBES], True, 1)
                if not first:
                    mine = ~mine & (bound >= floor[at][:, None] - SLACK)
                row, cell = np.nonzero(mine)
                part = b.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(part.column(c) for c in ("dim", "vec_id", "embedding", "floor"))], names=["cell", "dim", "vec_id", "embedding", "floor"])

    kinds = dict(queries.dtypes)
    return queries.mapInArrow(run, f"cell int, dim int, vec_id long, embedding {kinds['embedding']}, floor double")


def _probe(index: Index, wanted: DataFrame, k: int, own: bool, touched) -> DataFrame:  # noqa: ANN001
    counts = wanted.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts"))
    asked = wanted.join(F.broadcast(counts), ["dim", "cell"]).groupBy("dim", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).agg(F.collect_list(F.struct("vec_id", "embedding", "floor")).alias("asked"))
    pairs = index.packs.join(asked.select("dim", "cell", "asked"), ["dim", "cell"])  # counts: CELLS rows at most for each dimension
    models = index.models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                items = one.column("asked")[0].values
                dim, cell, radius, ids, x = next(_packs(one))
                q = items.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(items), dim).astype(np.float64)
                s = Search(items.field(0).to_numpy(zero_copy_only=False), q, k, own, models[dim], items.field(2).to_numpy(zero_copy_only=False).copy())
                s.take(cell, radius, ids, x)
                if touched is not None:
                    touched.add(s.touched)
                yield s.hits()

    return pairs.select("dim", "cell", "radius", "ids", "values", "asked").mapInArrow(run, HITS)


def search(queries: DataFrame, index: Index, k: int, own: bool = False, touched=None, limit: int = BROADCAST_BYTES) -> DataFrame:  # noqa: ANN001
    """q, vec_id, score (inner product, six digits), pool (from 1): the k best of the index for each query (vec_id, embedding), ties to the smaller id.

    `own`: whether a query may find its own id. `touched`: an accumulator of the pairs compared. Query ids are unique.
    """
    importable(queries.sparkSession)
    asked = _usable(queries)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = lambda hits: hits.withColumn("pool", F.row_number().over(order).cast("long")).where(F.col("pool") <= k)
    size = asked.agg(F.coalesce(F.sum(F.col("dim") * 8 + 16), F.lit(0))).first()[0]
    if size <= limit:
        return top(_read_once(index, asked.collect(), k, own, touched))  # within the limit
    some = stored(_probe(index, _wanted(asked.withColumn("floor", F.lit(float("-inf"))), index.models, True), k, own, touched), "probed")
    kth = top(some).where(F.col("pool") == k).select(F.col("q").alias("vec_id"), "score")
    rest = asked.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("score", F.lit(float("-inf")))).drop("score")
    return top(some.unionByName(_probe(index, _wanted(rest, index.models, False), k, own, touched)))
