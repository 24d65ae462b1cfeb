"""Best-fit packing of token sequences.

Bounded-space online best-fit: at most OPEN bins are open; a bitset has a bit for each free space that some open bin has, so
the tightest bin that holds a piece is found by one shift and one lowest-bit test. With all bins open, the fullest closes. OPEN is as
large as a bin has tokens: with half of it, a window's long pieces close each other's bins before the short ones come to fill them.
Each partition packs its own documents: nothing is shuffled. Pieces wait in a window of WINDOW and enter longest first; only
their numbers are held, never their tokens.

Defined results: null text counts as empty and yields the separator alone; repeated rows are packed each; a null doc_id is
packed too; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm._shared import ready

CAPACITY, OPEN, WINDOW, SEPARATOR, CACHE = 2048, 2048, 65536, 0, 600_000
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Places lengths into bins of a capacity with a fixed number of open bins."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN):
        self.capacity, self.limit = capacity, limit
        self.bits, self.bins, self.n_open, self.made = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _push(self, free: int, number: int) -> None:
        self.bins[free].append(number)
        self.bits |= 1 << free
        self.n_open += 1

    def _pop(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._pop(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
            if self.n_open >= self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        if left := free - length:
            self._push(left, number)
        return number, self.capacity - free


class WordIds(dict):
    """White-space-separated chunk -> its ids as little-endian uint32 bytes, by the vocabulary file of a BPE with word ends.

    Chunks are independent, as the file's pre-tokenizer never joins across white space. New chunks of a batch are encoded in
    one call; the table is emptied when it holds CACHE chunks.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the file's pattern

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
        raw = {}
        for piece, i in vocab.items():
            if i < len(vocab) - 2:  # without the two special tokens
                body, end = (piece[:-4], b" ") if piece.endswith("</w>") else (piece, b"")
                raw.setdefault(bytes(to_byte[c] for c in body) + end, i)
        # A space marks the end of a word; it cannot be within one. All single bytes rank first, then bytes with an end.
        space = raw.pop(b" ", None)
        ranks = {bytes([b]): n for n, b in enumerate(range(256))}
        ranks |= {k: 256 + n for n, k in enumerate(sorted((k for k in raw if len(k) > 1), key=raw.get))}
        self.to_id = np.zeros(len(ranks), dtype="<u4")
        self.ends = np.zeros(len(ranks), dtype=bool)
        for k, n in ranks.items():
            self.to_id[n], self.ends[n] = raw.get(k, space or 0), k.endswith(b" ") and len(k) > 1
        self.bpe = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(self.SPLIT).findall

    def learn(self, chunks: Iterable[str]) -> None:
        if len(self) > CACHE:
            self.clear()
        todo, words, counts = [], [], []
        for c in chunks:
            if c in self:
                continue
            if "<|" in c or "Σ" in c or "\x00" in c:  # special tokens, and a letter whose lower case depends on its place elsewhere
                self[c] = np.array(self.whole.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            found = self.find((c if c.isascii() else unicodedata.normalize("NFC", c)).lower())
            todo.append(c)
            words += found
            counts.append(len(found))
        if not words:
            self.update(dict.fromkeys(todo, b""))
            return
        ids = np.array(self.bpe.encode_ordinary(" ".join(words) + " "), dtype=np.int64)
        ends = np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1)) * 4
        flat, at = self.to_id[ids].tobytes(), ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        self.update({c: flat[a:b] for c, a, b in zip(todo, at, at[1:], strict=False)})


_words: dict[str, WordIds] = {}
_SPACE = re.compile("[ \n\t]+")


def document_ids(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as bytes, without the separator."""
    if path not in _words:
        _words[path] = WordIds(path)
    table = _words[path]
    chunks = [t.replace("\n", " ").replace("\t", " ").split(" ") if t else [] for t in texts]
    table.learn({c for part in chunks for c in part})
    return [b"".join(map(table.__getitem__, part)) for part in chunks]


def _pack(path: str, capacity: int, limit: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        fit, held = BestFit(capacity, limit), []
        separator = SEPARATOR.to_bytes(4, "little")

        def placed() -> pa.RecordBatch:
            held.sort(key=lambda p: -p[3])
            spots = [fit.place(p[3]) for p in held]
            cols = [*zip(*held, strict=True), [first + s for s, _ in spots], [o for _, o in spots]]
            held.clear()
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):  # a few million characters at a time
                to, size = at, 0
                while to < len(texts) and size < 4_000_000:
                    size += len(texts[to] or "")
                    to += 1
                for doc, ids in zip(b.column(0)[at:to].to_pylist(), document_ids(texts[at:to], path), strict=True):
                    ids += separator
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        held.append((doc, n, start // 4, len(part) // 4, zlib.crc32(part)))
                at = to
                if len(held) >= window:
                    yield placed()
        if held:
            yield placed()

    return run


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, limit: int = OPEN, window: int = WINDOW) -> DataFrame:
    """A row for each piece of each row of documents (columns doc_id, text), with the sequence it is in and its offset there."""
    ready(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_pack(tokenizer_path, capacity, limit, window), PACKED)
