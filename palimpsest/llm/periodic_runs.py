"""Runs of words that repeat with a period, and texts with each run collapsed to its first period.

For a run of period q, at least max(q, 12 - q) consecutive words equal the word q places on. So a lag is only looked at if that many
pairs of equal words are q apart. All pairs are counted exactly: a frequent word's by FFT autocorrelation of its places, a rare word's by
the differences of its places, all rare words of a batch of texts at once. A lag with enough pairs is scanned for islands of consecutive
matches: first on a grid of q / 8, of which an island of q must cover several points in a row, then word by word around them.
An island whose stretch has a smaller period, which divides q, belongs to that period's run.

Defined results: a null text has no words; a null doc_id is never rotated; texts of under 12 words have no runs; repeated rows are reported
each; a text is held whole by one task, with some 100 bytes a word; an empty table gives no rows; further columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm._shared import ready

LEAST, GRID, BATCH_WORDS = 12, 8, 400_000
FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def frequent_from(n: int) -> float:
    """Occurrences from which a word's pairs cost more than its autocorrelation over n words."""
    return max(48.0, 0.6 * np.sqrt(n * np.log2(n + 2)))


def pairs_by_lag(codes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each text codes[bounds[i]:bounds[i + 1]], how many pairs of equal words are 0, 1, 2, ... up to half its words apart (0: not counted)."""
    n = np.diff(bounds)
    room = n // 2 + 1
    base = np.concatenate(([0], np.cumsum(room)))
    total = np.zeros(base[-1], dtype=np.int64)
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.diff(key[order], prepend=-1))
    times = np.diff(np.concatenate((heads, [len(order)])))
    limit = np.array([frequent_from(k) for k in n.tolist()])[text[order[heads]]] if len(heads) else np.zeros(0)
    heavy = times > limit
    for i in np.unique(text[order[heads[heavy]]]).tolist():
        size = 1 << int(2 * n[i] - 1).bit_length()
        mine = np.flatnonzero(heavy & (text[order[heads]] == i))
        power = np.zeros(size // 2 + 1)
        for h in mine.tolist():
            there = np.zeros(size)
            there[order[heads[h] : heads[h] + times[h]] - bounds[i]] = 1.0
            spectrum = np.fft.rfft(there)
            power += spectrum.real**2 + spectrum.imag**2
        total[base[i] : base[i + 1]] += np.rint(np.fft.irfft(power, size)[: room[i]]).astype(np.int64)
    light = np.repeat(~heavy & (times > 1), times)
    at, same = order[light], key[order][light]
    live, held, size, step = np.arange(len(at)), [], 0, 1
    while live.size:
        live = live[: np.searchsorted(live, len(at) - step)]
        live = live[same[live + step] == same[live]]  # the step-th next place of the same word
        lag, where = at[live + step] - at[live], text[at[live]]
        inside = lag < room[where]  # later places are further still
        live = live[inside]
        held.append(base[where[inside]] + lag[inside])
        size += len(live)
        if size > 1 << 20 or not live.size:
            total += np.bincount(np.concatenate(held), minlength=len(total))
            held, size = [], 0
        step += 1
    total[base[:-1]] = 0
    return np.split(total, base[1:-1])


def _islands(flags: np.ndarray) -> np.ndarray:
    """(from, to) of each stretch of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def _smaller_periods(q: int) -> list[int]:
    """q over each of its prime divisors: a stretch's smaller period, if it has one that divides q, divides one of these."""
    out, rest, r = [], q, 2
    while r * r <= rest:
        if rest % r == 0:
            out.append(q // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return out + ([q // rest] if rest > 1 else [])


def runs_of(codes: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period; pairs[q] is the number of pairs of equal words q apart."""
    n, out = len(codes), []
    lags = np.arange(len(pairs))
    for q in np.flatnonzero((pairs >= np.maximum(lags, LEAST - lags)) & (lags > 0)).tolist():
        need = max(q, LEAST - q)
        # Runs found so far whose period divides q account for islands of matches at q as well.
        known = [(s, e) for s, e, p in out if q % p == 0 and e - s >= q + need]
        if pairs[q] - sum(e - s - q for s, e in known) < need:
            continue
        step = max(1, q // GRID)
        hits = _islands(codes[: n - q : step] == codes[q:n:step])
        for a, b in hits[np.diff(hits, axis=1)[:, 0] >= need // step].tolist():
            if any(s <= a * step and (b - 1) * step + q < e for s, e in known):
                continue
            # The grid's points before a and at b don't match, so no island passes them.
            low, high = max((a - 1) * step + 1, 0), min(b * step, n - q)
            for x, y in (_islands(codes[low:high] == codes[low + q : high + q]) + low).tolist():
                if y - x >= need and not any(np.array_equal(codes[x : y + q - p], codes[x + p : y + q]) for p in _smaller_periods(q)):
                    out.append((x, y + q, q))
    return sorted((s, e - s, p) for s, e, p in out)


def rotated(n: int, h: int) -> np.ndarray | None:
    """Which original word each of n words becomes if h asks for it: from a certain word on, they repeat with a period."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def scan_texts(doc_ids: list[int | None], texts: list[str | None]) -> list[tuple]:
    """A row of FOUND for each text."""
    number: dict[bytes, int] = {}
    coded, words = [], []
    for doc_id, text in zip(doc_ids, texts, strict=True):
        own = text.encode().split() if text else []  # bytes split at exactly the six white-space characters
        place = None if doc_id is None else rotated(len(own), zlib.crc32(str(doc_id).encode()))
        if place is not None:
            own = [own[i] for i in place.tolist()]
        coded.append(np.fromiter((number.setdefault(w, len(number)) for w in own), dtype=np.int64, count=len(own)))
        words.append(own)
    bounds = np.concatenate(([0], np.cumsum([len(c) for c in coded])))
    out = []
    for doc_id, own, codes, pairs in zip(doc_ids, words, coded, pairs_by_lag(np.concatenate([*coded, np.zeros(0, dtype=np.int64)]), bounds), strict=True):
        found = runs_of(codes, pairs) if len(codes) >= LEAST else []
        best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None, None, None)
        if found:
            cut = np.zeros(len(own) + 1, dtype=np.int64)
            for s, length, q in found:
                cut[s + q] += 1
                cut[s + length] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(cut[:-1]) == 0).tolist()]
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
        out.append((doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(own)).hexdigest()))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split() for x in FOUND.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in names]
    for b in batches:
        doc_ids, texts, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size < 6 * BATCH_WORDS:  # some six characters a word
                size += len(texts[to] or "")
                to += 1
            cols = zip(*scan_texts(doc_ids[at:to], texts[at:to]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[name for name, _ in names])
            at = to


def find_runs(documents: DataFrame) -> DataFrame:
    """A row of FOUND for each row of documents (columns doc_id, text): the number of runs, the longest one (ties: smallest start, then
    period) with its exponent in thousandths, and digests of the list of runs and of the text without what repeats a run's first period.
    """
    ready(documents.sparkSession)
    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_scan, FOUND)
