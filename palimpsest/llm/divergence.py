"""Audit of sources: how far the term distributions of the sources of a language lie from each other.

A lookup table of 256 bytes finds the terms in the concatenated UTF-8 buffers of a batch; XXH64, computed for all slices at once,
groups equal ones, and every slice is compared with its group's first one byte by byte. A batch becomes a CSR matrix of documents by
terms, summed by (lang, source), and only these sums are shuffled. Languages' kept terms are then dealt into blocks of terms; a block
is a CSR matrix of sources by terms, and sums over its rows (`reduceat`) give the divergences of every two sources in it.

With counts c of a term in a group, N of all kept terms in it and V kept terms in the language, the share is
p = 1 + floor(10^9 (c + 5) / (N + 5 V)). Integers throughout: exact for N + 5 V up to 2.8 * 10^14 and for any number of rows.

Defined results: null text, lang and source count as ''; an empty text has no terms, but its group is reported; repeated rows count each; a
language without kept terms has divergence 0 between all its sources and no part `term`; a language with one source has no part
`pair`; ties go to the item that is smaller as UTF-8 bytes; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._shared import ready, stored

LEAST_DOCUMENTS, RANKS, SCALE, PRIOR = 30, 50, 10**9, 5
#: Bytes of text a matrix is made of, and counts in a block of kept terms on average.
BATCH, BLOCK = 4 << 20, 200_000
COUNTED = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Each byte of a term in lower case, 0 for bytes between terms.
TABLE = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def slice_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice of data, which must have 8 bytes after the last slice. Slices of 32 bytes or more go one by one."""
    import xxhash

    words = np.lib.stride_tricks.as_strided(data.view(np.uint8), (max(len(data) - 7, 0), 8), (1, 1))
    h = np.uint64(seed) + _P5 + lengths.astype(np.uint64)
    at, left = starts.copy(), np.where(lengths < 32, lengths, 0)
    with np.errstate(over="ignore"):
        while (on := np.flatnonzero(left >= 8)).size:
            lane = words[at[on]].view("<u8")[:, 0]
            h[on] = _turned(h[on] ^ (_turned(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
        if (on := np.flatnonzero(left >= 4)).size:
            lane = words[at[on], :4].copy().view("<u4")[:, 0].astype(np.uint64)
            h[on] = _turned(h[on] ^ (lane * _P1), 23) * _P2 + _P3
            at[on] += 4
            left[on] -= 4
        while (on := np.flatnonzero(left)).size:
            h[on] = _turned(h[on] ^ (data[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
        for by, factor in ((33, _P2), (29, _P3)):
            h = (h ^ (h >> np.uint64(by))) * factor
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(lengths >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]].tobytes(), seed)
    return h


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the slices from a and b, equally long, have the same bytes."""
    words = np.lib.stride_tricks.as_strided(data.view(np.uint8), (max(len(data) - 7, 0), 8), (1, 1))
    same, on, done = np.ones(len(a), dtype=bool), np.flatnonzero(a != b), 0
    while (on := on[lengths[on] > done]).size:
        x, y = words[a[on] + done].view("<u8")[:, 0] ^ words[b[on] + done].view("<u8")[:, 0], np.minimum(lengths[on] - done, 8)
        same[on] &= (x << (np.uint64(8) * (8 - y).astype(np.uint64))) == 0  # only the slice's own bytes of the eight
        done += 8
    return same


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of texts that follow each other in data, from offsets[i] to offsets[i + 1]: lower-cased bytes with 8 more at the end, starts, ends, and the text of each."""
    low = np.concatenate((TABLE[data], np.zeros(8, dtype=np.uint8)))
    inside = low[: len(data)] != 0
    first = np.zeros(len(data) + 1, dtype=bool)  # where a text begins, a term cannot go on
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))[: len(data)]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))[: len(data)]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def grouped(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, group): the first slice of each group of equal slices, and each slice's group. Equal hashes of different bytes stay apart."""
    hashes = slice_hashes(low, starts, lengths)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    same = (lengths == lengths[first[group]]) & _same(low, starts, starts[first[group]], np.minimum(lengths, lengths[first[group]]))
    if not same.all():
        more, known = list(first), {}
        for i in np.flatnonzero(~same).tolist():
            own = low[starts[i] : starts[i] + lengths[i]].tobytes()
            if own not in known:
                known[own] = len(more)
                more.append(i)
            group[i] = known[own]
        first = np.array(more)
    return first, group


def counted(texts: pa.Array, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and for each (group, term) that occurs: group, number of the term, occurrences and texts. Texts without nulls, groups from 0."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    low, starts, ends, text = terms(data, offsets - offsets[0])
    if not starts.size:
        return [], *[np.zeros(0, dtype=np.int64)] * 4
    first, term = grouped(low, starts, ends - starts)
    # CSR: rows are texts, in the order of their groups; a row's terms follow each other.
    order = np.argsort(groups, kind="stable")
    row = np.empty(len(order), dtype=np.int64)
    row[order] = np.arange(len(order))
    cell, times = np.unique(row[text] * len(first) + term, return_counts=True)
    # Its rows are summed by group: cells of one group and term come together.
    key = groups[order][cell // len(first)] * len(first) + cell % len(first)
    by = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(key[by]) != 0)))
    n, docs = np.add.reduceat(times[by], heads), np.diff(np.concatenate((heads, [len(by)])))
    at = key[by][heads]
    return [low[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], at // len(first), at % len(first), n, docs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        column = lambda i: pc.fill_null(t.column(i).combine_chunks().cast(pa.large_string()), "")
        names = pa.StructArray.from_arrays([column(0), column(1)], ["lang", "source"])
        keys = list(map(tuple, map(dict.values, names.to_pylist())))
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        words, group, term, n, docs = counted(column(2), np.fromiter((number[k] for k in keys), dtype=np.int64, count=len(keys)))
        known = list(number)
        # Each group once without a term too, so that none is lost.
        lang, source = ([known[g][i] for g in group.tolist()] + [k[i] for k in known] for i in (0, 1))
        return pa.RecordBatch.from_arrays([
            pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array([*[words[i].decode() for i in term.tolist()], *[None] * len(known)], pa.string()),
            pa.array(np.concatenate((n, np.zeros(len(known), dtype=np.int64)))), pa.array(np.concatenate((docs, np.zeros(len(known), dtype=np.int64)))),
        ], names=[x.split()[0] for x in COUNTED.split(", ")])

    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 64):
            held.append(b.slice(at, 64))
            size += int(pc.sum(pc.binary_length(held[-1].column(2))).as_py() or 0)
            if size >= BATCH:
                yield summed(held)
                held, size = [], 0
    if held:
        yield summed(held)


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 5) / total), by division in two steps, so that no product passes 63 bits; total 0 gives 0."""
    a, b = n + PRIOR, np.maximum(total, 1)
    one, rest = np.divmod(a * 32_000, b)
    return np.where(total > 0, 1 + one * 31_250 + rest * 31_250 // b, 0)


def block_divergences(n_sources: int, totals: np.ndarray, lang_total: int, row: np.ndarray, term: np.ndarray, n: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, p, q): sums[s, t] of |p_s - p_t| over the terms of a block; p of each given count, and its term's share in the language.

    Counts are sorted by row (source), and there is one for each (row, term) that occurs. `totals` are N + 5 V of each source.
    """
    zero = share(np.zeros(n_sources, dtype=np.int64), totals)
    p = share(n, totals[row])
    q = p
    if n.size:
        by = np.argsort(term, kind="stable")
        in_lang = np.add.reduceat(n[by], np.searchsorted(term[by], np.arange(n_terms)))
        q = share(in_lang, np.full(n_terms, lang_total))[term]
    bounds = np.searchsorted(row, np.arange(n_sources + 1))
    some = np.flatnonzero(np.diff(bounds))
    sums = np.zeros((n_sources, n_sources), dtype=np.int64)
    for s in range(n_sources):
        own = slice(bounds[s], bounds[s + 1])
        dense = np.full(n_terms, zero[s])
        dense[term[own]] = p[own]
        # As if all other sources lacked every term: own terms sorted, then sums of those below and above each source's share.
        mine = np.sort(p[own])
        below = np.concatenate(([0], np.cumsum(mine)))
        k = np.searchsorted(mine, zero)
        sums[s] = (2 * k - len(mine)) * zero + below[-1] - 2 * below[k] + (n_terms - len(mine)) * np.abs(zero - zero[s])
        # Then what each other source has is put right, row by row.
        if n.size:
            change = np.abs(p - dense[term]) - np.abs(zero[row] - dense[term])
            sums[s, some] += np.add.reduceat(change, bounds[:-1][some])
    return sums, p, q


def _divergences(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    lang = key[0].as_py()
    groups = groups.sort_by("source")
    sources = groups.column("source").to_pylist()
    vocabulary = groups.column("v")[0].as_py()
    totals = np.array(groups.column("total").to_pylist(), dtype=np.int64) + PRIOR * vocabulary
    words = counts.column("term").combine_chunks().dictionary_encode()
    number = {s: i for i, s in enumerate(sources)}
    row = np.fromiter((number[s] for s in counts.column("source").to_pylist()), dtype=np.int64, count=counts.num_rows)
    order = np.argsort(row, kind="stable")
    row, term, n = row[order], words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], counts.column("n").to_numpy()[order]
    sums, p, q = block_divergences(len(sources), totals, groups.column("lang_total")[0].as_py() + PRIOR * vocabulary, row, term, n, len(words.dictionary))
    # Of a source's terms only the RANKS best can be among its best in all blocks.
    more = np.flatnonzero(p > q)
    more = more[np.lexsort((-(p - q)[more], row[more]))]
    names = np.array([w.encode() for w in words.dictionary.to_pylist()], dtype=object)
    picked = []
    for own in np.split(more, np.flatnonzero(np.diff(row[more])) + 1):
        gap = (p - q)[own]
        own = own[gap >= gap[RANKS - 1]] if len(own) > RANKS else own  # ties with the last too
        picked += sorted(own.tolist(), key=lambda i: (q[i] - p[i], names[term[i]]))[:RANKS]
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    source = [sources[i] for i in a.tolist()] + [sources[row[i]] for i in picked]
    item = [sources[i] for i in b.tolist()] + [names[term[i]].decode() for i in picked]
    part = ["pair"] * len(a) + ["term"] * len(picked)
    value = np.concatenate((sums[a, b], (p - q)[picked])).astype(np.int64)
    return pa.table({"lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value)})


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank, as described above, of documents (columns text, lang, source)."""
    ready(documents.sparkSession)
    rows = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    sums = rows.mapInArrow(_counts, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = stored(sums, "terms")
    wide = sums.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= least)
    kept = stored(sums.join(wide.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "kept")
    of_lang = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    counts = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("nnz"))
    groups = (
        sums.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(of_lang, "lang", "left").join(counts, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v", "lang_total", "nnz")))
        .withColumn("blocks", (F.ceil(F.col("nnz") / block)).cast("int"))
    )
    groups = stored(groups.withColumn("blocks", F.greatest("blocks", F.lit(1))), "groups")
    dealt = kept.join(groups.select("lang", "blocks").distinct(), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    each = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = dealt.select("lang", "block", "source", "term", "n").groupBy("lang", "block").cogroup(
        each.select("lang", "block", "source", "total", "v", "lang_total").groupBy("lang", "block")).applyInArrow(_divergences, PARTS)
    pairs = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))  # a term is in one block
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks))


def oracle() -> str:
    """The same in SQL."""
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
        gt AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + {PRIOR}) // (total + {PRIOR} * v.v)) AS p
              FROM gt g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + {PRIOR}) // (sum(sum(n)) OVER (PARTITION BY lang) + {PRIOR} * any_value(v.v))) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
        f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
              UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source ANTI JOIN v ON v.lang = a.lang
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        r AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM f)
        SELECT * FROM r WHERE part = 'pair' OR rank <= {RANKS}"""
