"""Near copies of the pipeline: covering SimHash finds candidates, the exact Jaccard similarity of word-shingle sets confirms them.

Sets: a text's distinct word shingles, by their XXH64 (seed 42). Equal sets are one node from the start.
Fingerprint: WORDS words of 64 bits over the set (simhash.majority). The places of the first SEARCH words are dealt to six parts
of 32, and each part is searched by the covering masks for radius 3: any pair whose SEARCH words differ in at most 23 bits
agrees under a mask, and so does any pair with a part that differs in 3 bits or fewer. At a similarity of 0.8 a bit differs
with a chance of acos(8/9)/pi = 0.151 (29 of 192 bits); masks also hold most pairs of 4 and some of 5 bits a part, so by
simulation 0.96 of such pairs are found, of those at 0.82 0.98, at 0.85 0.99, at 0.9 0.999.
Links: a candidate is one only if its two sets have 5 |A and B| >= 4 |A or B|; nothing is accepted by estimate. What is
compared exactly is within FIRST_BITS of the COMPARED first words (0.995 of pairs at 0.8), and in later rounds within ALL_BITS
of all words (0.98).

Rounds, so that dense groups don't cost all their pairs: 1. of each bucket each node with its nearest other (in buckets over
BUCKET nodes of its neighbours in order and of the first node); 2. where a bucket still has several components, each node with
the LIKELY nearest of other components; 3. all pairs of different components that are left. Buckets over TILE nodes are dealt block
against block. So a dense group costs its residue times its size, but a group whose pairs are just below 0.8 costs its square.

Defined results: null and empty texts have the empty set and are copies of each other; the smallest non-null doc_id of a group
stays, of rows that share it the one with the least digest; null ids stay only where a group has no other; repeated rows are
copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import bounded, one_of_each, ready, stored, with_class
from palimpsest.llm.simhash import components, covering_masks, majority, shingle_hashes

SEARCH, COMPARED, WORDS, FIRST_BITS, ALL_BITS, BUCKET, NEIGHBOURS, TILE, LIKELY = 3, 2, 10, 29, 115, 4096, 32, 4096, 4
MASKS = np.array(covering_masks((1 << 64) - 1, 7, 2), dtype=np.uint64)
_SALT = np.random.default_rng(42).integers(0, 1 << 63, SEARCH * len(MASKS), dtype=np.uint64).reshape(SEARCH, -1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, width))


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest as h64

    return h64(hashes.tobytes(), 1)


def keys(prints: np.ndarray) -> np.ndarray:
    """For each fingerprint (a row of SEARCH words) its bucket under each mask."""
    out = (prints[:, :SEARCH, None] & MASKS) ^ _SALT
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return out.reshape(len(prints), -1) * np.uint64(0xC2B2AE3D27D4EB4F)


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, value = [], []
            for x in b.column(2):
                hashes = shingles(x.as_py(), width)
                node.append(_node(hashes))
                value.append(majority(hashes, WORDS).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(value, pa.binary())], names=["doc_id", "xx", "node", "value"])

    return run


def _words(column: pa.Array, width: int = WORDS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, value): key, first, second, node for each mask."""
    for b in batches:
        node, value, n = b.column(0).to_numpy(zero_copy_only=False), _words(b.column(1)), SEARCH * len(MASKS)
        cols = [keys(value).ravel(), np.repeat(value[:, 0], n), np.repeat(value[:, 1], n), np.repeat(node, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names=["key", "first", "second", "node"])


def nearest(cols: list[np.ndarray], new: np.ndarray, reach: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in runs (new: where each begins) the nearest row of the own run up to `reach` rows off, and the bits they differ in."""
    size = np.diff(np.append(new, len(cols[0])))
    left = np.repeat(new + size, size) - np.arange(len(cols[0]))
    best, bits = np.arange(len(cols[0])), np.full(len(cols[0]), most + 1, dtype=np.int64)
    live, d = np.flatnonzero(left > 1), 1
    while len(live) and d <= reach:
        other = live + d
        differ = sum(np.bitwise_count(c[live] ^ c[other]).astype(np.int64) for c in cols)
        for x, y in ((live, other), (other, live)):
            better = differ < bits[x]
            bits[x[better]], best[x[better]] = differ[better], y[better]
        d += 1
        live = live[left[live] > d]
    return best, bits


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: key, node, other for each row that may have a link in its bucket, other the likeliest."""

    def out(cols: list[np.ndarray], best: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (cols[0][which], cols[3][which], best[which])], names=["key", "node", "other"])

    def whole(cols: list[np.ndarray]) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
        best, bits = nearest(cols[1:3], new, BUCKET, FIRST_BITS)
        return out(cols, cols[3][best], bits <= FIRST_BITS)

    def piece(cols: list[np.ndarray], hub: list[np.ndarray]) -> pa.RecordBatch:
        """A part of a bucket over BUCKET nodes: every row goes on."""
        best, bits = nearest(cols[1:3], np.zeros(1, dtype=np.int64), NEIGHBOURS, FIRST_BITS)
        far = sum(np.bitwise_count(c ^ h).astype(np.int64) for c, h in zip(cols[1:3], hub[1:3], strict=True))
        return out(cols, np.where(far <= bits, hub[3], cols[3][best]), np.ones(len(far), dtype=bool))

    held = [np.empty(0, dtype=np.uint64)] * 4
    hub = None  # the first row of a bucket that comes in parts
    for b in batches:
        cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False).view(np.uint64))) for h, c in zip(held, b.columns, strict=True)]
        if hub is not None and len(cols[0]):
            n = int(np.argmin(np.append(cols[0] == hub[0], False)))
            if n:
                yield piece([c[:n] for c in cols], hub)
                cols = [c[n:] for c in cols]
            hub = hub if not len(cols[0]) else None
        if not len(cols[0]):
            held = cols
            continue
        cut = len(cols[0]) - int(np.argmin(np.append((cols[0] == cols[0][-1])[::-1], False)))
        if cut:
            yield whole([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
        if len(held[0]) > BUCKET:
            hub = [c[:1] for c in held]
            yield piece(held, hub)
            held = [c[:0] for c in held]
    if len(held[0]):
        yield whole(held)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x.as_py(), width) for x in b.column(0)]
            node = np.array([_node(x) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "value"])

    return run


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = ([np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()] for i in (2, 3))
        ok = pa.array([similar(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in (0, 1)], names=["a", "b"])


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, and their values (node, value). A node that is in very many pairs must be their a."""
    total = pairs.count()
    right = pairs.join(values.select(F.col("node").alias("b"), F.col("value").alias("vb")), "b")
    left = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(values.select(F.col("node").alias("a"), F.col("value").alias("va")), "a")
    return with_class(right, left, "a", "n", total).select("a", "b", "va", "vb")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, keys, value, size): value followed by a bit for each mask whose key is in keys, in two words, and the size."""
    for b in batches:
        value = _words(b.column(2))
        has = np.zeros((b.num_rows, 128), dtype=bool)
        for i, (own, listed) in enumerate(zip(keys(value).view(np.int64), b.column(1).to_pylist(), strict=True)):
            has[i, : len(own)] = np.isin(own, listed)
        told = np.concatenate((value, np.packbits(has, axis=1).view("<u8"), b.column(3).to_numpy(zero_copy_only=False).astype("<u8")[:, None]), axis=1)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in told], pa.binary())], names=["node", "keys", "value"])


def _cross(most: int):
    """Over rows (block: -1 where a block meets itself) sorted by (bucket, tile): candidates between different components, a of the larger; of each b the `most` likeliest (0: all).

    A pair is made once, in the bucket of the first mask whose bucket both are in, and between two blocks only of rows of either.
    """

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, _, block, node, root, told = rows
        value, size = told[:, :WORDS], told[:, -1].astype(np.int64)
        has = np.unpackbits(np.ascontiguousarray(told[:, WORDS:-1]).view(np.uint8), axis=1)[:, : SEARCH * len(MASKS)].astype(bool)
        _, own, count = np.unique(root, return_inverse=True, return_counts=True)
        rank = np.lexsort((np.arange(len(count)), count)).argsort()[own]  # the larger component of two has the higher rank
        found = []
        for i in np.flatnonzero(rank != len(count) - 1):
            at = np.flatnonzero((rank > rank[i]) & (5 * np.minimum(size, size[i]) >= 4 * np.maximum(size, size[i])))
            at = at[block[at] != block[i]] if block[i] >= 0 else at
            differ = np.bitwise_count(value[at] ^ value[i]).sum(1, dtype=np.int64)
            at, differ = at[differ <= ALL_BITS], differ[differ <= ALL_BITS]
            both = (((value[at, :SEARCH] ^ value[i, :SEARCH])[:, :, None] & MASKS) == 0).reshape(len(at), SEARCH * len(MASKS)) & has[at] & has[i]
            here = keys(value[i : i + 1])[0].view(np.int64)[both.argmax(1)] == key[0]
            at, differ = at[here], differ[here]
            at = at[np.argsort(differ, kind="stable")[:most]] if most else at
            if len(at):
                found.append((node[at], np.full(len(at), node[i])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [*(c.to_numpy(zero_copy_only=False) for c in b.columns[:5]), _words(b.column(5), WORDS + 3)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            edges = [0, *(np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1).tolist()]
            for x, y in zip(edges, edges[1:]):
                yield from pairs([c[x:y] for c in cols])
            held = [c[edges[-1] :] for c in cols]
        if held is not None:
            yield from pairs(held)

    return run


def similar_links(prints: DataFrame, documents: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """a, b: links that connect the nodes of prints just as all its candidate pairs of similarity 0.8 or more do."""
    nodes = stored(prints.groupBy("node").agg(F.first("value").alias("value"), F.min(F.struct("doc_id", "xx")).alias("row")), "nodes")
    values = nodes.select("node", "value")
    prints.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    dealt = values.mapInArrow(_dealt, "key long, first long, second long, node long").repartition("key").sortWithinPartitions("key", "first", "node")
    found = stored(dealt.mapInArrow(_first, "key long, node long, other long"), "found")
    shared = stored(found.groupBy("node").agg(F.collect_list("key").alias("keys")), "shared")
    large = stored(found.groupBy("key").count().where(F.col("count") > tile).select("key", F.expr(f"cast((count - 1) div {tile} + 1 as int)").alias("g")), "large")
    # The texts of these nodes are read once more, for their sets.
    rows = stored(nodes.join(shared.select("node"), "node", "left_semi").select(F.col("row.doc_id").alias("row_id"), F.col("row.xx").alias("row_xx")), "rows")
    texts = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("xx"))
    some = texts.join(bounded(rows, 64), F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("xx") == F.col("row_xx")), "left_semi")
    sets = stored(some.select("text").mapInArrow(_sets(width), "node long, value binary").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return stored(_beside(stored(pairs, "pairs"), sets).mapInArrow(_exact, "a long, b long"), "links")

    sizes = sets.select("node", F.expr("length(value) div 8").cast("long").alias("size"))
    told = stored(shared.join(values, "node").join(sizes, "node").select("node", "keys", "value", "size").mapInArrow(_told, "node long, keys array<long>, value binary"), "told")
    links = confirmed(found.where("node <> other").select(F.col("other").alias("a"), F.col("node").alias("b")).distinct())
    for most in (LIKELY, 0):
        named = told.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = named.select(F.explode("keys").alias("key"), "node", "root", "value")
        if large.isEmpty():
            rows = rows.withColumn("tile", F.lit(0).cast("long")).withColumn("block", F.lit(-1))
        else:
            rows = rows.join(bounded(large, 32), "key", "left").withColumn("own", F.expr("cast(pmod(xxhash64(node), coalesce(g, 1)) as int)"))
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)))
            rows = rows.withColumn("tile", (F.least("own", "other") * F.coalesce("g", F.lit(1)) + F.greatest("own", "other")).cast("long")).withColumn("block", F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")))
        tiles = rows.select("key", "tile", "block", "node", "root", "value").repartition("key", "tile").sortWithinPartitions("key", "tile", "node")
        links = links.unionByName(confirmed(tiles.mapInArrow(_cross(most), "a long, b long").distinct()))
    return links


def _grouped(documents: DataFrame, width: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, xx, node) and for each node its group's row that stays (keep_id, keep_xx), its group's rows (rows) and its own (size)."""
    ready(documents.sparkSession)
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("xx"), "text")
    prints = stored(rows.mapInArrow(_prints(width), "doc_id long, xx long, node long, value binary"), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "xx"))
    nodes = prints.groupBy("node").agg(least.alias("least"), F.count(F.lit(1)).alias("size"))
    named = stored(nodes.join(components(similar_links(prints, documents, width, tile)), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    groups = named.groupBy("root").agg(F.min("least").alias("keep"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows"))
    joined = with_class(named, stored(groups, "groups"), "root", "n", named.count())
    return prints, stored(joined.select("node", F.col("keep.doc_id").alias("keep_id"), F.col("keep.xx").alias("keep_xx"), "rows", "size"), "classes")


def drop_similar(documents: DataFrame, width: int = 5, tile: int = TILE) -> DataFrame:
    """documents with one row of each group of near copies; all its columns stay."""
    prints, classes = _grouped(documents, width, tile)
    rows = with_class(prints.select("doc_id", "xx", "node"), classes.where("rows > 1"), "node", "size", prints.count()).where("rows is not null")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("xx") == F.col("keep_xx"))
    rows = stored(rows.select("doc_id", "xx", kept.alias("kept")), "grouped")
    gone = stored(rows.where("not kept").select("doc_id", "xx").distinct(), "gone")
    repeated = stored(rows.where("kept").groupBy("doc_id", "xx").count().where("count > 1").select("doc_id", "xx"), "repeated")
    return one_of_each(documents, F.coalesce(F.col("text"), F.lit("")), gone, repeated)
