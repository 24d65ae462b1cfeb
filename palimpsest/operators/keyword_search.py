"""Keyword search with substring semantics through an inverted index of character trigrams.

Documents are dealt into blocks. In a block each trigram (and each single and double character) has a list of the documents it occurs
in: ascending numbers, stored as the gaps between them in one or two bytes. The documents that may hold a word are those in all lists of
its trigrams; they are then looked at. A block scores a query for all its documents at once and passes on its best only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.frames import BROADCAST_BYTES, importable, stored

#: Documents of a block on average; gaps must be below 2 ** 14.
BLOCK = 2048


def coded(numbers: np.ndarray) -> bytes:
    """Ascending numbers as gaps: seven bits a byte, low ones first, the high bit set where another byte follows."""
    gaps = np.diff(numbers, prepend=-1) - 1
    if gaps.size and gaps.max() >= 1 << 14:
        raise ValueError("a gap is too wide")
    wide = gaps >= 128
    at = np.cumsum(1 + wide) - 1 - wide
    out = np.zeros(len(gaps) + int(wide.sum()), dtype=np.uint8)
    out[at] = (gaps & 127) | (wide << 7)
    out[at[wide] + 1] = gaps[wide] >> 7
    return out.tobytes()


def decoded(code: bytes) -> np.ndarray:
    """The numbers that `coded` made code of."""
    b = np.frombuffer(code, dtype=np.uint8).astype(np.int64)
    more = b >= 128
    first = np.concatenate(([True], ~more[:-1]))[: len(b)]
    gaps = b & 127
    gaps[more] += b[1:][more[:-1]] << 7
    return np.cumsum(gaps[first] + 1) - 1


@dataclass
class Index:
    """documents: block, number, doc_id, hay; lists: block, gram, list."""

    documents: DataFrame
    lists: DataFrame
    blocks: int


def build(documents: DataFrame, key: str, *fields: str) -> Index:
    """The index of the lower-cased fields, joined by a space, of all rows; null fields are left out. Keys may be repeated or null."""
    importable(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.lower(F.concat_ws(" ", *fields)).alias("hay"))
    blocks = max(1, -(-documents.select(key).count() // BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "hay"), F.lit(blocks)).cast("int"))
    # Rows alike are in one block, whatever their number.
    rows = stored(rows.withColumn("number", F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "hay")) - 1), "searched")

    def lists(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        found: dict[str, list[int]] = {}
        for number, hay in enumerate(table.column("hay").to_pylist()):
            for gram in {hay[i : i + n] for n in (1, 2, 3) for i in range(len(hay) - n + 1)}:
                found.setdefault(gram, []).append(number)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(found), pa.int32()), "gram": pa.array(list(found), pa.string()), "list": pa.array([coded(np.array(x)) for x in found.values()], pa.binary())})

    grams = rows.select("block", "number", "hay").groupBy("block").applyInArrow(lambda t: lists(t), "block int, gram string, list binary")
    return Index(rows, stored(grams, "grams"), blocks)


def _grams(word: str) -> list[str]:
    return [word] if len(word) < 3 else sorted({word[i : i + 3] for i in range(len(word) - 2)})


def search(queries: DataFrame, key: str, text: str, index: Index, k: int = 10) -> DataFrame:
    """q, doc_id, score, rank: for each query the k documents with the largest share of its words (split at white space, repeats count) as
    substrings, ties to the smaller doc_id; only scores above 0. Null or blank queries find nothing.

    Queries go in packs of a checked size, each to all blocks.
    """
    importable(queries.sparkSession)
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    asked = queries.select(F.col(key).alias("q"), words.alias("words")).where(F.size("words") > 0)
    asked = stored(asked, "asked")
    packs = max(1, -(-asked.agg(F.coalesce(F.sum(F.aggregate("words", F.lit(0), lambda n, w: n + F.octet_length(w) + 8)), F.lit(0))).first()[0] // (BROADCAST_BYTES // 8)))
    packed = asked.withColumn("pack", F.pmod(F.xxhash64("q"), F.lit(packs)).cast("int"))
    kind = dict(asked.dtypes)["q"]
    part = packed.groupBy("pack").agg(F.collect_list(F.struct("q", "words")).alias("asked"))  # a pack is of bounded size
    gram = F.explode(F.array_distinct(F.flatten(F.transform(F.flatten("asked.words"), lambda w: F.when(F.length(w) < 3, F.array(w)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))))))
    wanted = part.select("pack", gram.alias("gram"))
    lists = index.lists.join(wanted, "gram").select("block", "pack", "gram", "list")
    each = F.broadcast(part) if packs == 1 else part
    docs = index.documents.crossJoin(F.broadcast(queries.sparkSession.range(packs).selectExpr("cast(id as int) as pack")))  # a few packs

    def score(key: tuple, lists: pa.Table, docs: pa.Table, asked: list) -> pa.Table:
        docs = docs.sort_by("number")
        hays, ids = docs.column("hay").to_pylist(), docs.column("doc_id").to_pylist()
        order = np.array([-(1 << 63) if i is None else i for i in ids])
        known = dict(zip(lists.column("gram").to_pylist(), lists.column("list"), strict=True))
        seen: dict[str, np.ndarray] = {}

        def holders(word: str) -> np.ndarray:
            if word not in seen:
                codes = [known.get(g) for g in _grams(word)]
                found = np.zeros(0, dtype=np.int64)
                if all(c is not None for c in codes):
                    found = decoded(min((c.as_py() for c in codes), key=len))
                    for c in codes:
                        found = np.intersect1d(found, decoded(c.as_py()), assume_unique=True)
                    if len(word) > 3:
                        found = np.array([i for i in found.tolist() if word in hays[i]], dtype=np.int64)
                seen[word] = found
            return seen[word]

        out = []
        for q, words in asked:
            hits = np.zeros(len(hays), dtype=np.int64)
            for w in words:
                hits[holders(w)] += 1
            best = np.lexsort((order, -hits))[:k]
            out += [(q, ids[i], int(hits[i]), len(words)) for i in best.tolist() if hits[i]]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"q": pa.array(cols[0]), "doc_id": pa.array(cols[1], pa.int64()), "hits": pa.array(cols[2], pa.int64()), "n": pa.array(cols[3], pa.int64())})

    # The queries of a pack come with each block, once.
    with_asked = docs.groupBy("block", "pack").agg(F.collect_list(F.struct("number", "doc_id", "hay")).alias("docs")).join(each, "pack")

    def run(key: tuple, lists: pa.Table, blocks: pa.Table) -> pa.Table:
        made = []
        for r in range(blocks.num_rows):
            items = blocks.column("docs")[r].values
            asked = [(x["q"], x["words"]) for x in blocks.column("asked")[r].as_py()]
            made.append(score(key, lists, pa.table({n: items.field(i) for i, n in enumerate(("number", "doc_id", "hay"))}), asked))
        empty = pa.table({"q": pa.array([], schema_q), "doc_id": pa.array([], pa.int64()), "hits": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return pa.concat_tables([t.set_column(0, "q", t.column("q").cast(schema_q)) for t in made]) if made else empty

    schema_q = pa.int64() if kind in ("bigint", "int") else pa.string()
    hits = lists.groupBy("block", "pack").cogroup(with_asked.groupBy("block", "pack")).applyInArrow(lambda key, a, b: run(key, a, b), f"q {kind}, doc_id long, hits long, n long")
    ranked = hits.withColumn("score", F.col("hits") / F.col("n")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("q", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
