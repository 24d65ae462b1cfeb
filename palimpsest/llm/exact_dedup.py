"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Each partition sorts its distinct 64-bit fingerprints by owner (a range of fingerprints) and sends the gaps Golomb-coded
   (Rice's form: the divisor is a power of two).
2. An owner decodes its lists and answers each sender with a bitmap: which of its fingerprints occur elsewhere too.
3. Only rows whose fingerprint is marked, the suspects, send their text. They are grouped by the very bytes, combined in
   each partition before the shuffle, so a group with a third of all rows arrives as one row per partition.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays, and rows that repeat that
doc_id all stay; a null doc_id is smaller than any other (a group with null ids only keeps them all); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import ascii_lower, bounded, one_of_each, ready, stored, with_class

SENT = "owner int, sender long, n int, k int, codes binary, twice binary"
ANSWER = "owner int, sender long, bits binary"


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct uint64 values as Rice codes of their gaps (the first counts from 0).

    Two streams, so that decoding needs no walk: quotients in unary (ones, then a zero) behind their byte length, and
    remainders of k bits each.
    """
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    stop = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.ones(int(stop[-1]) + 1, dtype=np.uint8)
    unary[stop] = 0
    head = np.packbits(unary).tobytes()
    low = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - k :]
    return len(head).to_bytes(4, "little") + head + np.packbits(low).tobytes()


def golomb_decode(codes: bytes, n: int, k: int) -> np.ndarray:
    """The n values that golomb_encode was given."""
    if not n:
        return np.empty(0, dtype=np.uint64)
    size = int.from_bytes(codes[:4], "little")
    stop = np.flatnonzero(np.unpackbits(np.frombuffer(codes, np.uint8, size, 4)) == 0)[:n]
    gaps = (np.diff(stop, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.zeros((n, 64), dtype=np.uint8)
        low[:, 64 - k :] = np.unpackbits(np.frombuffer(codes, np.uint8, offset=4 + size))[: n * k].reshape(n, k)
        gaps |= np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _width(owners: int) -> int:
    """Fingerprints of one owner: a range of this width."""
    return -(-(1 << 64) // owners)


def _send(owners: int):
    width = _width(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not seen:
            return
        prints, counts = np.unique(np.concatenate(seen).view(np.uint64), return_counts=True)
        edges = np.searchsorted(prints, np.array([min(o * width, (1 << 64) - 1) for o in range(owners)], dtype=np.uint64))
        edges = np.append(edges, len(prints))
        sender, out = TaskContext.get().partitionId(), []
        for o in range(owners):
            part, many = prints[edges[o] : edges[o + 1]], counts[edges[o] : edges[o + 1]] > 1
            if not len(part):
                continue
            rel = part - np.uint64(o * width)
            k = min(63, int(np.log2(max(1.0, width / len(part) * 0.69))))
            out.append((o, sender, len(part), k, golomb_encode(rel, k), np.packbits(many).tobytes()))
            if len(out) >= 256:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
        names=["owner", "sender", "n", "k", "codes", "twice"],
    )


def _answer(table: pa.Table) -> pa.Table:
    """An owner's bitmaps, one for each sender."""
    owner, sender, n, k, codes, twice = (table.column(i).to_pylist() for i in range(6))
    lists = [golomb_decode(c, m, j) for c, m, j in zip(codes, n, k, strict=True)]
    everything, counts = np.unique(np.concatenate(lists), return_counts=True)
    again = np.concatenate([x[np.unpackbits(np.frombuffer(t, dtype=np.uint8))[:m] == 1] for x, t, m in zip(lists, twice, n, strict=True)])
    shared = np.union1d(everything[counts > 1], again)
    bits = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pa.table({"owner": pa.array(owner, pa.int32()), "sender": pa.array(sender, pa.int64()), "bits": pa.array(bits, pa.binary())})


def _suspects(owners: int):
    width = _width(owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, n, k, codes, bits in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                mark = np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[:n] == 1
                if mark.any():
                    found = golomb_decode(codes, n, k)[mark] + np.uint64(o * width)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["fp"])

    return run


#: Fingerprints of one owner, at most, on average: their lists fill some tens of MB.
OWNED = 1 << 20


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The rows (doc_id, fp, sha), the groups of several rows (sha, keep_id, group_size), and the number of rows."""
    spark = documents.sparkSession
    ready(spark, 10_000)
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = documents.select("doc_id", text.alias("_text"))
    prints = stored(rows.select("doc_id", F.xxhash64("_text").alias("fp"), F.unhex(F.sha2("_text", 256)).alias("sha")), "prints")
    total = prints.count()
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNED))
    sent = stored(prints.select("fp").mapInArrow(_send(owners), SENT), "codes")
    answers = sent.groupBy("owner").applyInArrow(_answer, ANSWER)
    suspects = stored(
        sent.select("owner", "sender", "n", "k", "codes").join(answers, ["owner", "sender"])
        .select("owner", "n", "k", "codes", "bits").mapInArrow(_suspects(owners), "fp long").distinct(),
        "suspects",
    )
    # Bytes decide: one group per text. Its digest then stands for it, so no text travels twice.
    texts = rows.withColumn("fp", F.xxhash64("_text")).join(bounded(suspects, 64), "fp", "left_semi")
    classes = stored(
        texts.groupBy("_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.unhex(F.sha2("_text", 256)).alias("sha"), "keep_id", "group_size"),
        "classes",
    )
    return prints, classes, total


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of documents (columns doc_id, text)."""
    prints, classes, total = _classes(documents)
    joined = with_class(prints.select("doc_id", "sha"), classes, "sha", "group_size", total)
    single = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(single, True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(documents: DataFrame) -> DataFrame:
    """documents with one row of each group of equal texts; all its columns stay.

    That row has the group's largest doc_id, or null if it has no other. Rows are told apart by doc_id and text, so of rows that
    repeat the doc_id that stays any one stays, and a doc_id that also has another text keeps that.
    """
    prints, classes, total = _classes(documents)
    rows = with_class(prints, classes, "sha", "group_size", total).where("group_size is not null")
    rows = stored(rows.select("doc_id", F.col("fp").alias("xx"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")), "grouped")
    gone = stored(rows.where("not kept").select("doc_id", "xx").distinct(), "gone")
    repeated = stored(rows.where("kept").groupBy("doc_id", "xx").count().where("count > 1").select("doc_id", "xx"), "repeated")
    return one_of_each(documents, ascii_lower(F.coalesce(F.col("text"), F.lit(""))), gone, repeated)
