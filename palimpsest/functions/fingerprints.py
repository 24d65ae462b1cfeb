"""Winnowed fingerprints of texts: hashes of byte grams, of which each window keeps its smallest.

Two texts that share a run of `gram + window - 1` bytes share the smallest hash of that run's window, wherever the run stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once.
BATCH = 4 << 20


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of data[i : i + gram] for each i: polynomials of halves put together, then mixed."""
    h, size, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, taken, bits = None, 0, gram
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                if out is None:
                    out = h
                else:
                    n = len(h) - taken
                    out = out[:n] * power + h[taken:] if n > 0 else h[:0]
                taken += size
            bits >>= 1
            if bits:
                h = h[:-size] * power + h[size:] if len(h) > size else h[:0]
                size, power = 2 * size, power * power
        out = (out ^ (out >> np.uint64(32))) * _MIX
        return (out ^ (out >> np.uint64(29))) * _MIX


def sliding_least(h: np.ndarray, window: int) -> np.ndarray:
    """The least of h[i : i + window] for each i."""
    size = 1
    while 2 * size <= window and len(h) > size:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    rest = window - size
    return h if not rest else np.minimum(h[:-rest], h[rest:]) if len(h) > rest else h[:0]


def winnowed(data: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint), each pair once, of texts data[offsets[i] : offsets[i + 1]]; texts shorter than a window have none."""
    least = sliding_least(gram_hashes(data, gram), window)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + gram + window - 1 <= offsets[1:][text]
    new = inside & np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])))[: len(least)]
    new |= inside & np.concatenate(([False], ~inside[:-1]))[: len(least)]
    text, least = text[new], least[new]
    order = np.lexsort((least, text))
    text, least = text[order], least[order]
    once = np.concatenate(([True], (text[1:] != text[:-1]) | (least[1:] != least[:-1])))[: len(text)]
    return text[once], least[once]


def fingerprints(classes: list[tuple[int, int]]):
    """A function for mapInArrow: (key, text) -> (key, gram, fps) for each text and each class (gram, window)."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        keys, texts = t.column(0).combine_chunks(), t.column(1).combine_chunks().cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        for gram, window in classes:
            text, fps = winnowed(data, offsets - offsets[0], gram, window)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(fps.view(np.int64)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(texts), gram), pa.int32()), lists], names=["key", "gram", "fps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                held.append(b.slice(at, 64))
                size += pc.sum(pc.binary_length(held[-1].column(1))).as_py() or 0
                if size >= BATCH:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return run
