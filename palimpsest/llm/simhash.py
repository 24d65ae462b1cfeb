"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 bits over word shingles (XXH64, seed 42); a bit is 1 if set in over half the shingles' hashes.
Search: masks from a linear map of bit places to non-zero vectors of r + 1 bits, one mask for each of the 2^(r+1) - 1
non-zero vectors v: it keeps the places whose vector has odd parity with v. The vectors of at most r differing places leave
some v orthogonal to them all, so every pair within radius r agrees under some mask: no link is lost.
Components: large-star and small-star rounds over stored tables; no link reaches the driver.

For a larger radius the places are dealt to `parts` groups: of at most radius differing places, one group has at most
radius // parts, so the masks of all groups for that smaller radius cover.

Equal fingerprints are one node from the start. Within a bucket only a spanning forest of its links is emitted. A bucket of
over BUCKET distinct fingerprints is dealt anew by the same masks over the bits it doesn't fix, until too few bits are free for
every mask to add one; then it is linked exactly, block against block.

Defined results: null and empty texts have fingerprint zero and are linked like others; repeated rows share their component;
a null doc_id takes part, but the smallest non-null doc_id names the component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import ready, stored, with_class

RADIUS, BUCKET = 3, 8192
LINK = "a long, b long, mask long"


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 of each shingle of `width` words (of all words, if fewer), lower-cased in A-Z only; none for no words."""
    from xxhash import xxh64_intdigest as h64

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([h64(joined, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.array([h64(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits set in over half the hashes; then as many of the same hashes mixed anew, for each further word."""
    out = np.zeros(words, dtype="<u8")
    for n in range(words if len(hashes) else 0):
        if n:
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        total = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 255):  # as many as a byte can count
            total += np.unpackbits(hashes[at : at + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
        out[n] = np.packbits((2 * total > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text over shingles of `width` words."""
    return int(majority(shingle_hashes(text, width))[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])

    return run


def covering_masks(free: int, radius: int = RADIUS, parts: int = 1) -> list[int]:
    """Masks over the bits set in `free`, such that two values that differ in at most `radius` of them agree under one."""
    places = [i for i in range(64) if free >> i & 1]
    count = (1 << radius // parts + 1) - 1
    return [sum(1 << p for n, p in enumerate(places[part::parts]) if ((n % count + 1) & v).bit_count() & 1) for part in range(parts) for v in range(1, count + 1)]


def _dealt(rows: DataFrame, radius: int, parts: int) -> DataFrame:
    """(fp, mask) rows, mask the bits fixed so far, as one row per covering mask: fp, mask, bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns]
            for m in np.unique(cols[1]):
                if int(m) not in known:
                    known[int(m)] = np.array([int(m) | x for x in covering_masks(~int(m) & (1 << 64) - 1, radius, parts)], dtype=np.uint64)
                own, to = cols[1] == m, known[int(m)]
                fp = cols[0][own]
                out = [np.repeat(fp, len(to)), np.tile(to, len(fp)), (fp[:, None] & to[None, :]).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in out], names=["fp", "mask", "bucket"])

    return rows.mapInArrow(run, "fp long, mask long, bucket long")


def _forest(fp: np.ndarray, length: np.ndarray, radius: int) -> np.ndarray:
    """For sorted runs (length: what is left of the own run, itself included), the index each row's component within radius starts at."""
    root = np.arange(len(fp))
    live, d = np.flatnonzero(length > 1), 1
    while len(live):
        near = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= radius]
        a, b = root[near], root[near + d]
        while len(a := a[differs := a != b]):
            b = b[differs]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
        d += 1
        live = live[length[live] > d]
    return root


def _links(radius: int, bucket: int):
    """Over rows sorted by (mask, bucket): a link from each row to its component's first; rows of too large buckets go back.

    A link has mask 0; a row that goes back has its fingerprint twice and the mask that made the bucket.
    """

    def out(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b, mask)], names=["a", "b", "mask"])

    def back(cols: list[np.ndarray]) -> pa.RecordBatch:
        return out(cols[0], cols[0], cols[1])

    def whole(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """For complete buckets."""
        if not len(cols[0]):
            return
        new = np.flatnonzero(np.concatenate(([True], (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1]))))
        size = np.diff(np.append(new, len(cols[0])))
        big = np.repeat(size > bucket, size)
        if big.any():
            yield back([c[big] for c in cols])
        small = ~big & (np.repeat(size, size) > 1)
        left = (np.repeat(new + size, size) - np.arange(len(cols[0])))[small]
        fp = cols[0][small]
        root = _forest(fp, left, radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        yield out(fp[at], fp[root[at]], np.zeros(len(at), dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, dtype=np.uint64)] * 3
        over = None  # the bucket that is being sent back
        for b in batches:
            cols = [np.concatenate((h, c.to_numpy(zero_copy_only=False).view(np.uint64))) for h, c in zip(held, b.columns, strict=True)]
            if over is not None and len(cols[0]):
                n = int(np.argmin(np.append((cols[1] == over[0]) & (cols[2] == over[1]), False)))
                yield back([c[:n] for c in cols])
                over = over if n == len(cols[0]) else None
                cols = [c[n:] for c in cols]
            if not len(cols[0]):
                held = cols
                continue
            last = (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = len(last) - int(np.argmin(np.append(last[::-1], False)))
            yield from whole([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
            if len(held[0]) > bucket:
                over = (held[1][0], held[2][0])
                yield back(held)
                held = [c[:0] for c in held]
        yield from whole(held)

    return run


def _tiled(rows: DataFrame, radius: int, bucket: int) -> DataFrame:
    """a, b: all links within each bucket (rows of one mask and fp & mask), block against block of about `bucket` fingerprints."""
    rows = rows.distinct().withColumn("bucket", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = rows.groupBy("mask", "bucket").agg(F.expr(f"cast((count(1) - 1) div {bucket} + 1 as int)").alias("g"))
    dealt = rows.join(sizes, ["mask", "bucket"]).withColumn("own", F.expr("cast(pmod(xxhash64(fp), g) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    tile = (F.least("own", "other") * F.col("g") + F.greatest("own", "other")).cast("long")
    # A tile has two blocks, however many fingerprints they hold, so nothing goes back.
    keyed = dealt.select("fp", F.xxhash64("mask", "bucket").alias("mask"), tile.alias("bucket"))
    keyed = keyed.repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")
    return stored(keyed.mapInArrow(_links(radius, 1 << 40), LINK), "tiles").select("a", "b").distinct()


def near_links(nodes: DataFrame, radius: int = RADIUS, parts: int = 1, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect the distinct fingerprints of nodes (column fp) just as all near pairs do."""
    nodes.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows, found = nodes.select("fp", F.lit(0).cast("long").alias("mask")), None
    # With fewer free places than this, some mask of the next deal may add no bit, and the bucket would come back for ever.
    least = parts * ((1 << radius // parts + 1) - 1)
    while True:
        dealt = _dealt(rows, radius, parts).repartition("mask", "bucket").sortWithinPartitions("mask", "bucket", "fp")
        out = stored(dealt.mapInArrow(_links(radius, bucket), LINK), "links")
        links = out.where("mask = 0").select("a", "b").distinct()
        found = links if found is None else found.unionByName(links)
        rows = out.where("mask <> 0").select(F.col("a").alias("fp"), "mask")
        stuck = rows.where(64 - F.bit_count("mask") < least)
        if not stuck.isEmpty():
            found = found.unionByName(_tiled(stuck, radius, bucket))
        rows = rows.where(64 - F.bit_count("mask") >= least)
        if rows.isEmpty():
            return found


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the links, root the smallest node of its component."""
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        # Large star: the larger neighbours of a node, and the node, go to the smallest of its neighbours and itself. A node
        # that a thousandth of the edges meet is joined by broadcast, so none of the joins gathers its edges.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        total = 2 * edges.count()
        large = with_class(both.where("v > u"), least, "u", "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of a node, and the node, go to the smallest of them.
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = with_class(large, least, "u", "n", total).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = stored(small, "edges")
        if edges.exceptAll(new).isEmpty() and new.exceptAll(edges).isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = new


def near_groups(documents: DataFrame, width: int = 3, radius: int = RADIUS, parts: int = 1) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of documents (columns doc_id, text)."""
    ready(documents.sparkSession)
    prints = stored(documents.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, fp long"), "prints")
    total = prints.count()
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")), "nodes")
    roots = components(near_links(nodes, radius, parts))
    named = stored(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root")), "named")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    classes = stored(with_class(named, least, "root", "n", named.count()).select("fp", "component_id", "size"), "classes")
    out = with_class(prints.select("doc_id", "fp"), classes, "fp", "size", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
