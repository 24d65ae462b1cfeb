"""Language identification by a byte convolutional network.

Bytes are folded to classes, embedded, convolved by filters of several widths, rectified, max-pooled over a window of WINDOW
bytes and classified by softmax; all is trained here in numpy. A text is cut into windows without a gap, every byte is read,
and its language is that of the mean log-probability of its windows, weighted by the bytes they hold.

Since inputs are discrete, applying the network needs no multiplication: the responses to byte pairs are tables.

Training takes at most PER_LANGUAGE documents (in expectation; chosen by a hash of doc_id) of each language, fewer if so many
languages would give more than DOCUMENTS in all, and PER_DOCUMENT windows of each, spread over the whole text. Every language
that has labels is learned.

Defined results: `und` with score 0 where text is null or has no letter, or where nothing could be learned; null doc_id is never
learned from and counts as not held out; repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import ready

WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 8, 8
PER_LANGUAGE, DOCUMENTS, PER_DOCUMENT = 1200, 76_800, 4
PREDICTED = "doc_id long, lang_pred string, score double"
_LATIN = re.compile("[a-zA-Z]")


def _folding() -> np.ndarray:
    """Byte -> class: 0 padding and controls, 1 space, 2 digit, 3 other ASCII, 4-29 letters without case, then the bytes from 128."""
    fold = np.full(256, 3, dtype=np.uint8)
    fold[:32] = 0
    fold[[9, 10, 13, 32]] = 1
    fold[48:58] = 2
    for i in range(26):
        fold[65 + i] = fold[97 + i] = 4 + i
    fold[128:] = 30 + np.arange(128)
    return fold


FOLD, CLASSES = _folding(), 158


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as class ids, padded, and the number of the text that each is from. Neighbours share the bytes a filter spans."""
    over = max(WIDTHS) - 1
    step = size - over
    counts = [max(1, -(-(len(t) - over) // step)) for t in texts]
    out = np.zeros((sum(counts), size), dtype=np.uint8)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        flat = np.zeros(n * step + over, dtype=np.uint8)
        flat[: len(t)] = FOLD[np.frombuffer(t, dtype=np.uint8)]
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, size)[::step]
        at += n
    return out, np.repeat(np.arange(len(texts)), counts)


class ByteNet:
    """The network: embedding, filters of each width, dense layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": r.normal(0, 0.5, (CLASSES, DEPTH)), "b": np.zeros(len(WIDTHS) * FILTERS), "d": r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))), "c": np.zeros(len(languages))}
        self.p |= {f"w{w}": r.normal(0, 1 / np.sqrt(w * DEPTH), (w, DEPTH, FILTERS)) for w in WIDTHS}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 128, rate: float = 0.01, seed: int = 3) -> ByteNet:
        """Adam on the cross-entropy. Through the max-pool only the winning place of each filter has a gradient."""
        r, p = np.random.default_rng(seed), self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = r.integers(0, len(x), min(batch, len(x)))
            xb, yb = x[pick], y[pick]
            n = np.arange(len(xb))
            emb, pooled, place = p["e"][xb], [], []
            for i, w in enumerate(WIDTHS):
                span = xb.shape[1] - w + 1
                z = sum(emb[:, j : j + span] @ p[f"w{w}"][j] for j in range(w))
                place.append(z.argmax(1))
                pooled.append(np.take_along_axis(z, place[-1][:, None], 1)[:, 0] + p["b"][i * FILTERS : (i + 1) * FILTERS])
            pre = np.concatenate(pooled, 1)
            hid = np.maximum(pre, 0)
            logit = hid @ p["d"] + p["c"]
            q = np.exp(logit - logit.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[n, yb] -= 1
            q /= len(xb)
            g = {"d": hid.T @ q + 1e-4 * p["d"], "c": q.sum(0), "e": np.zeros_like(p["e"])}
            back = (q @ p["d"].T) * (pre > 0)
            g["b"] = back.sum(0)
            for i, w in enumerate(WIDTHS):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    at = xb[n[:, None], place[i] + j]  # classes under the winning places
                    g[f"w{w}"][j] = np.einsum("nfd,nf->df", p["e"][at], own)
                    np.add.at(g["e"], at, own[:, :, None] * p[f"w{w}"][j].T[None])
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        return self

    def tables(self) -> ByteNet:
        """Responses to pairs of classes (all widths' first two), to the third of width 3, and to the last pair of width 4."""
        e, pair = self.p["e"], lambda a, b: (a[:, None] + b[None]).reshape(CLASSES**2, FILTERS)
        t = {w: [e @ k for k in self.p[f"w{w}"]] for w in WIDTHS}
        self.first = np.concatenate([pair(t[w][0], t[w][1]) for w in WIDTHS], 1).astype(np.float32)
        self.third, self.last = t[3][2].astype(np.float32), pair(t[4][2], t[4][3]).astype(np.float32)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """For windows of class ids; tables() must have been called."""
        out = []
        for at in range(0, len(x), 512):
            c = x[at : at + 512].astype(np.int32)
            two = c[:, :-1] * CLASSES + c[:, 1:]
            z = self.first[two[:, : x.shape[1] - 3]]
            z[:, :, FILTERS : 2 * FILTERS] += self.third[c[:, 2:-1]]
            z[:, :, 2 * FILTERS :] += self.last[two[:, 2:]]
            logit = np.maximum(z.max(1) + self.p["b"], 0) @ self.p["d"] + self.p["c"]
            logit -= logit.max(1, keepdims=True)
            out.append(logit - np.log(np.exp(logit).sum(1, keepdims=True)))
        return np.concatenate(out)

    def predict_all(self, texts: list[str | None], size: int = 1_000_000) -> list[tuple[str, float]]:
        """predict(), about `size` characters at a time."""
        said, at = [], 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and n < size:
                n += len(texts[to] or "")
                to += 1
            said += self.predict(texts[at:to])
            at = to
        return said

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) for each text."""
        said: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        real = [i for i, t in enumerate(texts) if t and (_LATIN.search(t) or any(map(str.isalpha, t)))]
        if not self.languages or not real:
            return said
        x, own = windows([texts[i].encode("utf-8", "replace") for i in real])
        weight = np.count_nonzero(x, axis=1).astype(np.float64) + 1e-9
        total = np.stack([np.bincount(own, weight * c, len(real)) for c in self.log_probabilities(x).T], 1)
        mean = total / np.bincount(own, weight, len(real))[:, None]
        q = np.exp(mean - mean.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        for i, row in zip(real, q, strict=True):
            said[i] = (self.languages[int(row.argmax())], min(1.0, float(row.max())))
        return said


def in_training(doc_id="doc_id"):  # noqa: ANN001, ANN201
    """Whether a document may be learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, most: int = DOCUMENTS, per_document: int = PER_DOCUMENT) -> ByteNet:
    """Learn from text and non-null lang of the documents outside the held-out third."""
    ready(documents.sparkSession)
    usable = documents.where(in_training() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().collect()
    per_language = min(per_language, most // max(1, len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, per_language / r["count"]))]) if counts else F.lit(None)
    names = sorted(r["lang"] for r in counts)
    if not names:
        return ByteNet([])
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, lang, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                raw = text.encode("utf-8", "replace")
                for n in range(per_document):
                    at = max(0, len(raw) - WINDOW) * n // max(1, per_document - 1)
                    if n == 0 or len(raw) > WINDOW:
                        rows.append((i, n, lang, raw[at : at + WINDOW]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n", "lang", "raw"])

    taken = usable.where(u < F.element_at(share, F.col("lang"))).select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, n int, lang string, raw binary")
    rows = sorted(taken.collect(), key=lambda r: (r.doc_id, r.n, r.lang, bytes(r.raw)))
    if not rows:
        return ByteNet([])
    x = np.concatenate([windows([bytes(r.raw)])[0][:1] for r in rows])
    return ByteNet(names).fit(x, np.array([names.index(r.lang) for r in rows])).tables()


def identify(documents: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents (columns doc_id, text)."""
    ready(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = net.predict_all(b.column(1).to_pylist())
            cols = list(zip(*said, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = documents.select("doc_id", "text").mapInArrow(run, PREDICTED)
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, net: ByteNet, least: float = 0.4) -> DataFrame:
    """documents whose language is known with a score of at least `least`; all their columns stay."""
    ready(documents.sparkSession)

    @F.pandas_udf("boolean")
    def known(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([lang != "und" and score >= least for lang, score in net.predict_all([t if isinstance(t, str) else None for t in text])], dtype=bool)

    return documents.where(known("text"))
