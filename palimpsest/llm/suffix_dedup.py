"""Removal of byte strings that repeat across documents, by column-wise construction of a collection's suffix order.

What is wanted: each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id.

1. Of equal texts all but those with the smallest doc_id go wholly; they need no search.
2. Texts are packed into blocks of BLOCK bytes, stored once. Each window of LENGTH bytes has an anchor: the least hash of the
   ANCHOR-byte strings in it. Equal windows have equal anchors. Blocks send the sorted low halves of their distinct anchors to
   owners (ranges of anchors), which answer with bitmaps: these occur in another document too.
3. Maximal runs of windows with one shared anchor are segments, of MAX_SEGMENT bytes at most. A block sends each distinct
   segment once, with its smallest doc_id, to the anchor's owner: equal windows meet there, and a passage that a third of all
   documents hold arrives once per block.
4. Equal windows have equal anchors, so a segment that is the only text under its anchor is in a class by itself. An owner
   builds the suffix order of all others column by column, for CHUNK segments of whole anchors at a time: each round puts one more symbol in front of every
   segment's suffix and passes over the Burrows-Wheeler transform and the common-prefix lengths of the round before, which lie
   in files that are read and written in sequence, BUFFER entries at a time. Suffixes with a common prefix of LENGTH or more form a class; its smallest
   doc_id goes back to the blocks, which mark, merge and cut.

Defined results: null text counts as empty; matches never cross documents, and a document never matches itself or rows with
the same doc_id; rows with null doc_id neither give nor lose anything; texts shorter than LENGTH stay; repeated rows repeat; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import BROADCAST_BYTES, bounded, ready, stored, with_class

LENGTH, ANCHOR, BLOCK, OWNED, CHUNK = 50, 24, 2 << 20, 64 << 20, 4000
SPAN = LENGTH - ANCHOR + 1  # anchors in a window; a segment has this many windows at most
MAX_SEGMENT = LENGTH + SPAN - 1
BUFFER = 1 << 16  # entries of the transform in memory at a time
SYMBOLS = 257  # bytes plus one, and 0
COLUMNS = (np.uint16, np.uint8, np.int32, np.uint8)  # transform, common prefix, segment, suffix size
NONE = np.iinfo(np.int64).max
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def suffix_classes(segments: np.ndarray, sizes: np.ndarray, length: int = LENGTH, folder: str | None = None, buffer: int = BUFFER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, suffix size, class) for each suffix of at least `length` bytes; equal first `length` bytes, equal class.

    segments: a row of bytes for each segment, padded. The list of suffixes in order starts with the empty ones. Each round puts
    in the suffixes that are one symbol longer, one for each segment that isn't whole yet: sorted by their first symbol, ties by
    the place of the rest. The transform (what precedes each suffix: the byte plus one, 0 in front of a whole segment), the
    common prefixes and the suffixes themselves lie in files, each read and written in sequence, `buffer` entries at a time. In
    memory are those entries, one record for each segment that isn't whole, and the result.
    """
    n = len(sizes)

    def before(seg: np.ndarray, size: int) -> np.ndarray:
        return np.where(size < sizes[seg], segments[seg, np.maximum(sizes[seg] - size - 1, 0)].astype(np.uint16) + 1, 0).astype(np.uint16)

    def create() -> list:
        return [tempfile.TemporaryFile(dir=folder) for _ in COLUMNS]

    def read(files: list, count: int) -> list[np.ndarray]:
        return [np.frombuffer(f.read(count * np.dtype(k).itemsize), k) for f, k in zip(files, COLUMNS, strict=False)]

    def write(files: list, columns: tuple) -> None:
        for f, c, k in zip(files, columns, COLUMNS, strict=True):
            f.write(np.ascontiguousarray(c, dtype=k).data)

    seg = np.arange(n, dtype=np.int32)  # of the suffixes whose extension isn't in the list yet, by place
    at, symbol, total, rounds = seg.astype(np.int64), before(seg, 0), n, 0
    counts = np.bincount(symbol, minlength=SYMBOLS)
    files = create()
    try:
        write(files, (symbol, np.zeros(n), seg, np.zeros(n)))
        at, seg = at[symbol > 0], seg[symbol > 0]
        while len(at):
            rounds += 1
            for f in files:
                f.seek(0)
            start = n + np.concatenate(([0, 0], np.cumsum(counts[1:-1])))  # a symbol's first place in the new list
            place, prefix, own = _new_places(lambda k: read(files[:2], k), total, at, start, buffer)  # noqa: B023
            by = np.argsort(place[own], kind="stable")
            fresh, fresh_prefix, seg = place[own][by], prefix[own][by], seg[by]
            by = np.argsort(place[~own], kind="stable")
            mended, mended_prefix = place[~own][by], prefix[~own][by]
            symbol = before(seg, rounds)
            total = n + int(counts[1:].sum())
            counts = counts + np.bincount(symbol, minlength=SYMBOLS)
            for f in files:
                f.seek(0)
            new = create()
            for a in range(0, total, buffer):
                e = min(total, a + buffer)
                x, y = np.searchsorted(fresh, (a, e))
                i, j = np.searchsorted(mended, (a, e))
                stay = np.ones(e - a, dtype=bool)
                stay[fresh[x:y] - a] = False
                merged = []
                for old, add in zip(read(files, e - a - (y - x)), (symbol[x:y], fresh_prefix[x:y], seg[x:y], rounds), strict=True):
                    out = np.empty(e - a, dtype=old.dtype)
                    out[stay], out[fresh[x:y] - a] = old, add
                    merged.append(out)
                merged[1][mended[i:j] - a] = mended_prefix[i:j]
                write(new, tuple(merged))
            for f in files:
                f.close()
            files = new
            at, seg = fresh[symbol > 0], seg[symbol > 0]
        for f in files:
            f.seek(0)
        out, number = [], 0
        for a in range(0, total, buffer):
            _, lcp, of, size = read(files, min(total, a + buffer) - a)
            classes = number + np.cumsum(lcp < length)
            number, kept = int(classes[-1]), size >= length
            out.append((of[kept], size[kept], classes[kept]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))
    finally:
        for f in files:
            f.close()


def _new_places(read, total: int, at: np.ndarray, start: np.ndarray, buffer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """One pass over the transform and the common prefixes: (place, common prefix, own) of extensions in the new list.

    at: places of the suffixes that are extended now. Two suffixes next to each other under one symbol have extensions that share
    one more byte than the least common prefix between them. So the extension of each suffix in `at` gets a prefix (own, in the
    order of at), and that of the next suffix under its symbol is mended (not own). What passes from buffer to buffer is, for each
    symbol, how often it came, whether its last suffix is in `at`, and the least common prefix since.
    """
    seen, last, since = np.zeros(SYMBOLS, dtype=np.int64), np.zeros(SYMBOLS, dtype=bool), np.full(SYMBOLS, 255, dtype=np.uint8)
    places, prefixes, owns = [], [], []
    for a in range(0, total, buffer):
        bwt, lcp = read(min(total, a + buffer) - a)
        extended = np.zeros(len(bwt), dtype=bool)
        extended[at[slice(*np.searchsorted(at, (a, a + len(bwt))))] - a] = True
        order = np.argsort(bwt, kind="stable")
        many = np.bincount(bwt, minlength=SYMBOLS)
        head = np.cumsum(many) - many
        kinds = np.flatnonzero(many)
        first, tail = order[head[kinds]], order[head[kinds] + many[kinds] - 1]
        mine = np.flatnonzero(extended[order])
        follow = mine[mine + 1 < len(order)] + 1
        follow = follow[(bwt[order[follow]] == bwt[order[follow - 1]]) & ~extended[order[follow]]]
        follow = np.concatenate((follow, head[kinds[last[kinds] & ~extended[first]]]))
        mine = mine[np.argsort(order[mine])]
        turn = np.concatenate((mine, follow))
        spot = order[turn]
        symbol = bwt[spot]
        nth = turn - head[symbol]
        lead = nth == 0  # the one before under the same symbol, if any, came in an earlier buffer
        open_tail = np.flatnonzero(tail + 1 < len(bwt))
        low = np.concatenate((np.where(lead, 0, order[turn - 1] + 1), tail[open_tail] + 1))
        least = _range_min(lcp, low, np.concatenate((spot, np.full(len(open_tail), len(bwt) - 1))))
        value = least[: len(turn)]
        value[lead] = np.minimum(value[lead], since[symbol[lead]])
        value = np.where(lead & (seen[symbol] == 0), 0, value + np.uint8(1)).astype(np.uint8)
        places.append(start[symbol] + seen[symbol] + nth)
        prefixes.append(value)
        owns.append(np.arange(len(turn)) < len(mine))
        since = np.minimum(since, lcp.min())
        since[kinds] = 255
        since[kinds[open_tail]] = least[len(turn) :]
        last[kinds] = extended[tail]
        seen += many
    return tuple(np.concatenate(c) for c in (places, prefixes, owns))


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) for each pair, from tables of minima over powers of two, one at a time."""
    out = np.empty(len(first), dtype=values.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    by = np.argsort(level.astype(np.uint8), kind="stable")
    edges = np.searchsorted(level, np.arange(level.max() + 2), sorter=by) if len(level) else [0]
    table = values
    for k in range(len(edges) - 1):
        if k:
            half = 1 << k - 1
            table = np.minimum(table[:-half], table[half:])
        own = by[edges[k] : edges[k + 1]]
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
    return out


class Block:
    """Some documents' bytes in a row, and the anchor of each of their windows."""

    def __init__(self, data: bytes):
        t = pa.ipc.open_stream(pa.py_buffer(data)).read_all()
        self.ids, self.texts = t.column(0).to_pylist(), t.column(1).to_pylist()
        self.sizes = np.array([len(x) for x in self.texts], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.doc = np.array([NONE if i is None else i for i in self.ids], dtype=np.int64)

    def windows(self) -> None:
        """Runs of windows with one anchor, cut to SPAN windows: start, windows, document's place, key; and the distinct keys in order."""
        raw, empty = self.raw, np.empty(0, dtype=np.int64)
        if len(raw) < LENGTH:
            self.run, self.count, self.of, self.keys, self.inverse, self.twice = empty, empty, empty, empty.astype(np.uint64), empty, empty.astype(bool)
            return
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view("<u8").ravel()
        n = len(raw) - ANCHOR + 1
        h = word[:n] * _MIX[0]
        h ^= h >> np.uint64(29)
        h += word[8 : 8 + n]
        h *= _MIX[1]
        h ^= h >> np.uint64(32)
        h += word[16 : 16 + n]
        h *= _MIX[2]
        h ^= h >> np.uint64(31)
        least, reach = h, 1
        while reach * 2 <= SPAN:
            least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
        least = np.minimum(least[: len(raw) - LENGTH + 1], least[SPAN - reach :][: len(raw) - LENGTH + 1])
        inside = np.zeros(len(least), dtype=bool)
        for s, e, d in zip(self.starts.tolist(), self.ends.tolist(), self.ids, strict=True):
            if d is not None and e - s >= LENGTH:
                inside[s : e - LENGTH + 1] = True
        change = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]))))
        # The last window of a document and the first of the next have LENGTH - 1 outside ones between them.
        long = np.diff(np.append(change, len(least)))
        change, long = change[inside[change]], long[inside[change]]
        parts = -(-long // SPAN)
        first = np.repeat(np.cumsum(parts) - parts, parts)
        shift = (np.arange(parts.sum()) - first) * SPAN
        self.run = np.repeat(change, parts) + shift
        self.count = np.minimum(SPAN, np.repeat(long, parts) - shift)
        self.of = np.searchsorted(self.ends, self.run, side="right")
        key = least[self.run] * _MIX[3]
        key ^= key >> np.uint64(32)
        key *= _MIX[0]
        self.keys, self.inverse = np.unique(key, return_inverse=True)
        by = np.argsort(self.inverse, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(self.inverse[by]) != 0)))
        docs = self.of[by]
        self.twice = np.minimum.reduceat(docs, edge) != np.maximum.reduceat(docs, edge) if len(edge) else np.zeros(0, dtype=bool)

    def edges(self, owners: int) -> np.ndarray:
        """Where each owner's range of the distinct keys begins; the last entry is their number."""
        width = -(-(1 << 64) // owners)
        return np.append(np.searchsorted(self.keys, np.array([min(o * width, (1 << 64) - 1) for o in range(owners)], dtype=np.uint64)), len(self.keys))


def _record(names: str, *cols: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


PACKED, SENT, MARKS = "block long, data binary", "owner int, block long, n int, low binary, twice binary", "owner int, block long, bits binary"
PIECES, LEAST, CUT = "owner int, block long, sizes binary, raw binary, least binary, keys binary", "owner int, block long, least binary", "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        t = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())})
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return _record(PACKED, [number], [sink.getvalue().to_pybytes()])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= BLOCK:
                yield out()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield out()


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = Block(data)
                x.windows()
                edges, low = x.edges(owners).tolist(), x.keys.astype(np.uint32)
                rows = [(o, number, e - a, low[a:e].tobytes(), np.packbits(x.twice[a:e]).tobytes()) for o, (a, e) in enumerate(zip(edges, edges[1:], strict=False)) if e > a]
                if rows:
                    yield _record(SENT, *map(list, zip(*rows, strict=True)))

    return run


def _answer(table: pa.Table) -> pa.Table:
    owner, block, n, low, twice = (table.column(i).to_pylist() for i in range(5))
    lists = [np.frombuffer(x, np.uint32) for x in low]
    own = [np.unpackbits(np.frombuffer(t, np.uint8))[:m].astype(bool) for t, m in zip(twice, n, strict=True)]
    together = np.sort(np.concatenate([np.unique(x) for x in lists]))
    again = np.unique(together[1:][together[1:] == together[:-1]])
    rows = []
    for o, b, x, t in zip(owner, block, lists, own, strict=True):
        bits = t | (again[np.minimum(np.searchsorted(again, x), len(again) - 1)] == x if len(again) else False)
        # A key that only this block holds twice is its own affair, but the bitmap says so all the same.
        if bits.any():
            rows.append((o, b, np.packbits(bits).tobytes()))
    return pa.Table.from_batches([_record(MARKS, *(map(list, zip(*rows, strict=True)) if rows else ([], [], [])))])


def _segments(x: Block, owners: int, marks: list) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each owner its distinct segments (sizes, padded bytes, smallest doc_id, anchor); and the runs they come from with their places among all of the block's segments."""
    x.windows()
    edges, shared = x.edges(owners), np.zeros(len(x.keys), dtype=bool)
    for m in marks:
        a, e = edges[m["owner"]], edges[m["owner"] + 1]
        shared[a:e] = np.unpackbits(np.frombuffer(m["bits"], np.uint8))[: e - a]
    run = np.flatnonzero(shared[x.inverse])
    if not len(run):
        return [], run, run
    owner = np.searchsorted(edges, x.inverse[run], side="right") - 1
    size = x.count[run] + LENGTH - 1
    wide = np.zeros((len(run), MAX_SEGMENT + 5), dtype=np.uint8)  # owner, size, bytes: sorted as one
    wide[:, :4] = owner.astype(">u4").view(np.uint8).reshape(-1, 4)
    wide[:, 4] = size
    at = x.run[run][:, None] + np.arange(MAX_SEGMENT)
    wide[:, 5:] = np.where(np.arange(MAX_SEGMENT) < size[:, None], x.raw[np.minimum(at, len(x.raw) - 1)], 0)
    distinct, place = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_inverse=True)
    least = np.full(len(distinct), NONE)
    np.minimum.at(least, place, x.doc[x.of[run]])
    keys = np.empty(len(distinct), dtype=np.uint32)
    keys[place] = x.keys[x.inverse[run]].astype(np.uint32)
    flat = distinct.view(np.uint8).reshape(-1, wide.shape[1])
    of = np.ascontiguousarray(flat[:, :4]).view(">u4").ravel()
    out = [(int(o), flat[a:e, 4], flat[a:e, 5:], least[a:e], keys[a:e]) for o in np.unique(of) for a, e in [np.searchsorted(of, [o, o + 1])]]
    return out, run, place


def _pieces(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, data, marks in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found, _, _ = _segments(Block(data), owners, marks)
                rows = [(o, number, s.tobytes(), w[np.arange(MAX_SEGMENT) < s[:, None]].tobytes(), m.tobytes(), k.tobytes()) for o, s, w, m, k in found]
                if rows:
                    yield _record(PIECES, *map(list, zip(*rows, strict=True)))

    return run


def _least(table: pa.Table) -> pa.Table:
    """For each window of each block's segments the smallest doc_id of its class."""
    owner, block, sizes, raw, least, keys = (table.column(i).to_pylist() for i in range(6))
    each = [len(s) for s in sizes]
    size = np.frombuffer(b"".join(sizes), np.uint8).astype(np.int64)
    wide = np.zeros((len(size), MAX_SEGMENT + 1), dtype=np.uint8)
    wide[:, 0] = size
    wide[:, 1:][np.arange(MAX_SEGMENT) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    distinct, place = np.unique(wide.view(f"V{MAX_SEGMENT + 1}").ravel(), return_inverse=True)
    del wide, raw
    low, key = np.full(len(distinct), NONE), np.empty(len(distinct), dtype=np.uint32)
    np.minimum.at(low, place, np.frombuffer(b"".join(least), "<i8"))
    key[place] = np.frombuffer(b"".join(keys), np.uint32)
    flat = distinct.view(np.uint8).reshape(-1, MAX_SEGMENT + 1)
    windows = flat[:, 0].astype(np.int64) - LENGTH + 1
    first = np.cumsum(windows) - windows
    best = np.repeat(low, windows)
    _, of, count = np.unique(key, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[of] > 1)
    several = several[np.argsort(of[several], kind="stable")]
    edges = np.append(np.flatnonzero(np.diff(of[several], prepend=-1)), len(several))
    at = 0
    while at < len(several):
        to = edges[max(np.searchsorted(edges, at, side="right"), np.searchsorted(edges, at + CHUNK, side="right") - 1)]
        mine, at = several[at:to], to
        seg, tail, classes = suffix_classes(np.ascontiguousarray(flat[mine, 1:]), flat[mine, 0].astype(np.int64))
        lowest = np.full(int(classes.max()) + 1, NONE)
        np.minimum.at(lowest, classes, low[mine[seg]])
        best[first[mine[seg]] + flat[mine[seg], 0] - tail] = lowest[classes]
    ends, rows = np.cumsum(each), []
    for o, b, e, n in zip(owner, block, ends.tolist(), each, strict=True):
        mine = place[e - n : e]
        rows.append((o, b, best[_ranges(first[mine], windows[mine])].tobytes()))
    return pa.Table.from_batches([_record(LEAST, *map(list, zip(*rows, strict=True)))])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., count[0] of them, then the same for the next."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _cut(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, marks, least in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = Block(data)
                change = np.zeros(len(x.raw) + 1, dtype=np.int32)
                if least:
                    found, runs, place = _segments(x, owners, marks)
                    best = np.concatenate([np.frombuffer(m["least"], "<i8") for m in sorted(least, key=lambda m: m["owner"])])
                    windows = np.concatenate([s for _, s, _, _, _ in found]).astype(np.int64) - LENGTH + 1
                    first = np.cumsum(windows) - windows
                    count = windows[place]
                    start = _ranges(x.run[runs], count)
                    gone = start[best[_ranges(first[place], count)] < np.repeat(x.doc[x.of[runs]], count)]
                    np.add.at(change, gone, 1)
                    np.add.at(change, gone + LENGTH, -1)
                cover = np.cumsum(change[:-1]) > 0
                rows = []
                for i, text, s, e in zip(x.ids, x.texts, x.starts.tolist(), x.ends.tolist(), strict=True):
                    c = cover[s:e]
                    n = int(c.sum())
                    spans = int(c[:1].sum() + np.count_nonzero(c[1:] & ~c[:-1])) if n else 0
                    kept = x.raw[s:e][~c].tobytes() if n else text
                    rows.append((i, e - s, n, spans, hashlib.sha256(kept).hexdigest()))
                yield _record(CUT, *map(list, zip(*rows, strict=True)))

    return run


def cut_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of documents (columns doc_id, text)."""
    spark = documents.sparkSession
    ready(spark)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digests = stored(rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    first = digests.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    marked = with_class(digests, stored(first, "first"), "sha", "size", digests.count())
    copies = stored(marked.where("least < doc_id").select("doc_id", "sha", "n_bytes"), "copies")
    dropped = bounded(copies.select("doc_id", "sha").distinct(), 160)
    searched = rows.withColumn("sha", F.sha2("text", 256)).join(dropped, ["doc_id", "sha"], "left_anti").select("doc_id", "text")
    blocks = stored(searched.mapInArrow(_pack, PACKED), "blocks")
    size = digests.agg(F.sum("n_bytes")).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNED))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    sent = blocks.mapInArrow(_send(owners), SENT)
    marks = sent.groupBy("owner").applyInArrow(_answer, MARKS).groupBy("block").agg(F.collect_list(F.struct("owner", "bits")).alias("marks"))
    marks = stored(marks, "marks")
    n = marks.agg(F.sum(F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: a + F.length(m["bits"]) + 32))).first()[0] or 0
    near = (lambda df: F.broadcast(df)) if n <= BROADCAST_BYTES else (lambda df: df)
    pieces = blocks.join(near(marks), "block").select("block", "data", "marks").mapInArrow(_pieces(owners), PIECES)
    least = pieces.groupBy("owner").applyInArrow(_least, LEAST).groupBy("block").agg(F.collect_list(F.struct("owner", "least")).alias("least"))
    out = blocks.join(near(marks), "block", "left").join(least, "block", "left").select("data", "marks", "least").mapInArrow(_cut(owners), CUT)
    long = F.col("n_bytes") >= LENGTH
    gone = copies.select(
        "doc_id", "n_bytes", F.when(long, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), F.when(long, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(long, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return out.unionByName(gone)
