"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Model: P(grade > j) = sigmoid(w.x - t_j) with ascending thresholds t_j and one weight vector for all; the expected severity is
the sum of these probabilities. Features are words and word beginnings (PREFIXES characters, so that word stems count), with
the logarithm of one plus their number per text, chosen by how much more often they occur in toxic texts: by a log odds of over ODDS,
and in LEAST toxic texts at least.

Labels say toxic or not; how severe a toxic text is, other texts tell: labelled documents are in two folds (by a hash of doc_id), and a
sentence counts as toxic if it holds a feature that was chosen in the other fold alone. The share of such sentences gives grade 1, 2 (over a
twentieth) or 3 (over 0.15), whatever the text's length; the model itself gets whole texts and the features of both folds.
Training takes at most SAMPLE labelled documents (in expectation, by a hash of doc_id) and VOCABULARY features; the choice of
features is counted by Spark, so the driver sees the sample's sparse rows only.

Defined results: null and empty texts have no feature and get the severity of the bare thresholds; without labelled documents
of both kinds all severities are 0; a doc_id labelled more than once is toxic if any label says so; null labels are ignored;
repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._shared import bounded, ready, stored

SAMPLE, VOCABULARY, LEAST, ODDS, PREFIXES, SHARES, CACHE = 20_000, 4096, 4, 2.0, (4, 5, 6, 7, 8), (0.05, 0.15), 400_000
GRADED = "doc_id long, expected_severity double, grade int, toxic boolean"
#: What each threshold's cross-entropy counts: that of toxic or not most, as only it is labelled.
LEVELS = np.array([1.0, 0.1, 0.1])
_WORD, _SENTENCE = re.compile(r"\w+"), re.compile(r"[^.!?\n]*\w[^.!?\n]*")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Features(dict):
    """Word -> the numbers of its features that are in the vocabulary (None: none)."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.number = {f: i for i, f in enumerate(vocabulary)}

    def __missing__(self, word: str) -> tuple[int, ...] | None:
        out = tuple(self.number[f] for f in word_features(word) if f in self.number) or None
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out

    def of(self, text: str | None) -> dict[int, int]:
        """Feature number -> how often it occurs in the text."""
        return Counter(i for found in map(self.__getitem__, _WORD.findall((text or "").lower())) if found for i in found)


class Ordinal:
    """Cumulative-link model with shared weights."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds
        self._features: Features | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_features": None}

    @staticmethod
    def loss(p: dict, rows: tuple, over: np.ndarray, decay: float) -> tuple[float, dict]:
        """Mean cross-entropy of grade > j, summed over all j, with its gradient. p: weights w, and t: the first threshold, then the logarithms of the steps to the next ones."""
        doc, col, val = rows
        n = len(over)
        score = np.bincount(doc, val * p["w"][col], n)
        steps = np.append(p["t"][:1], np.exp(p["t"][1:]))
        z = np.clip(score[:, None] - np.cumsum(steps)[None], -30, 30)
        loss = ((np.log1p(np.exp(z)) - over * z) * LEVELS).sum() / n + decay * (p["w"] ** 2).sum() / (2 * n)
        err = (1 / (1 + np.exp(-z)) - over) / n * LEVELS
        down = -err.sum(0)[::-1].cumsum()[::-1]
        return loss, {"w": np.bincount(col, val * err.sum(1)[doc], len(p["w"])) + decay * p["w"] / n, "t": np.append(down[:1], down[1:] * steps[1:])}

    @classmethod
    def fit(cls, vocabulary: list[str], rows: list[dict[int, int]], grades: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 0.5) -> Ordinal:
        """Gradient descent (Adam) on the binary cross-entropies of grade > j for all j at once."""
        levels = len(SHARES) + 1
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.array([i for r in rows for i in r], dtype=np.int64)
        val = np.log1p(np.array([c for r in rows for c in r.values()], dtype=np.float64))
        over = (grades[:, None] > np.arange(levels)[None]).astype(np.float64)
        # Thresholds stay in order: the first is free, each next one adds a positive step.
        p = {"w": np.zeros(len(vocabulary)), "t": np.array([2.0, *[0.5] * (levels - 1)])}
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for s in range(1, steps + 1):
            _, g = cls.loss(p, (doc, col, val), over, decay)
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-9)
        return cls(vocabulary, p["w"], np.cumsum(np.append(p["t"][:1], np.exp(p["t"][1:]))))

    def severity(self, text: str | None) -> tuple[float, int]:
        """(expected severity, most likely grade's lower bound: how many thresholds are passed with half the probability)."""
        if not len(self.weights):
            return 0.0, 0
        if self._features is None:
            self._features = Features(self.vocabulary)
        score = sum(self.weights[i] * np.log1p(c) for i, c in self._features.of(text).items())
        p = 1 / (1 + np.exp(-np.clip(score - self.thresholds, -60, 60)))
        return float(p.sum()), int((p >= 0.5).sum())


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Ordinal:
    """Learn from the labelled documents (documents: doc_id, text; labels: doc_id, toxic)."""
    spark = documents.sparkSession
    ready(spark)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) / float(1 << 24)
    chosen = known.where(u < min(1.0, sample / max(1, n)))
    rows = documents.select("doc_id", "text").join(bounded(chosen, 64, min(n, 2 * sample)), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    kinds = [(fold, toxic) for fold in (0, 1) for toxic in (0, 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = {k: Counter() for k in kinds}

        def sent() -> pa.RecordBatch:
            names = list(set().union(*texts.values()))
            out = [pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in texts.values())]
            for c in texts.values():
                c.clear()
            return pa.RecordBatch.from_arrays(out, names=["feature", "c0", "t0", "c1", "t1"])

        for b in batches:
            for text, toxic, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}
                texts[fold, int(toxic > 0)].update(found)
                if sum(map(len, texts.values())) >= CACHE:
                    yield sent()
        yield sent()

    # Every feature of every chosen text is counted; a task holds about CACHE of them and then sends its partial counts.
    counted = rows.select("text", "toxic", "fold").mapInArrow(count, "feature string, c0 long, t0 long, c1 long, t1 long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    sums = stored(counted.where(F.col("t0") + F.col("t1") >= LEAST), "features")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))
    sizes = {(r[0], r[1]): r[2] for r in chosen.groupBy(fold, (F.col("toxic") > 0).cast("int")).count().collect()}
    if not all(sum(sizes.get((f, toxic), 0) for f in (0, 1)) for toxic in (0, 1)):
        return Ordinal([], np.zeros(0), np.zeros(0))

    def picked(folds: tuple[int, ...]) -> list[str]:
        """The features that these folds choose."""
        t, c = (sum((F.col(f"{k}{f}") for f in folds), F.lit(0)) for k in "tc")
        m_t, m_c = (sum(sizes.get((f, toxic), 0) for f in folds) for toxic in (1, 0))
        odds = F.log((t + 0.5) / (m_t + 1)) - F.log((c + 0.5) / (m_c + 1))
        top = sums.withColumns({"t": t, "odds": odds}).where((F.col("t") >= LEAST) & (F.col("odds") > ODDS)).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "feature").limit(vocabulary)
        return sorted(r.feature for r in top.select("feature").collect())

    words = picked((0, 1))
    features, others = Features(words), {f: Features(picked((1 - f,))) for f in (0, 1)}

    def share(text: str | None, fold: int) -> float:
        """The share of a text's sentences that the other fold's features call toxic."""
        sentences = _SENTENCE.findall(text or "")
        return sum(bool(others[fold].of(x)) for x in sentences) / len(sentences) if sentences else 0.0

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, texts, toxic, folds = (c.to_pylist() for c in b.columns)
            found = [features.of(t) for t in texts]
            shares = [share(t, f) if x > 0 else 0.0 for t, x, f in zip(texts, toxic, folds, strict=True)]
            cols = [pa.array(doc_ids, pa.int64()), pa.array(toxic, pa.int64()), pa.array(shares, pa.float64()), *(pa.array([list(x) for x in part], pa.list_(pa.int64())) for part in (found, [f.values() for f in found]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "toxic", "share", "features", "counts"])

    known_rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("toxic").cast("long").alias("toxic"), "fold")
    got = sorted(known_rows.mapInArrow(sparse, "doc_id long, toxic long, share double, features array<long>, counts array<long>").collect(), key=lambda r: (r.doc_id, r.features))
    grades = np.array([0 if r.toxic <= 0 else 1 + sum(r.share > a for a in SHARES) for r in got])
    return Ordinal.fit(words, [dict(zip(r.features, r.counts, strict=True)) for r in got], grades)


def grade(documents: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_severity, grade, toxic (grade 1 or more) for each row of documents (columns doc_id, text)."""
    ready(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [model.severity(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in said], pa.float64()), pa.array([g for _, g in said], pa.int32()), pa.array([g > 0 for _, g in said], pa.bool_())], names=["doc_id", "expected_severity", "grade", "toxic"])

    return documents.select("doc_id", "text").mapInArrow(run, GRADED)
