"""Vectors, version-aware retrieval, and statistics over metric rows.

The index has a row per clause vector: vec_id % 3 is its policy's domain, (vec_id // 3) % 3 the version, label the clause, label % 4
its tag, and clauses of label 8 and 9 are of high or critical severity. Queries are the vectors whose vec_id is divisible by 20,
against all rows: n = vec_id // 20 is the case, n % 3 its domain, (n // 3) % 3 the version in force, n % 4 its tag, label the clause
it lacks evidence for. Vectors are searched through an inverted file (`vector_index`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from math import exp, factorial, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.frames import importable
from palimpsest.operators.vector_index import Index, search

POOL, K, EVERY = 30, 5, 20
#: Digests of features that a task keeps.
CACHE = 500_000
VERSIONS = ["1.0", "1.1", "2.0"]
# Whether a mode keeps effective hits of the case's domain only, reranks by metadata, and prefers the case's domain where it can.
MODES = {
    "naive": (False, False, False), "date_filtered": (True, False, False), "metadata_rerank": (False, True, True), "date_filtered_rerank": (True, True, False),
}
# What the rerank adds for the case's domain, for being in force or not, for each of the case's words, for severity.
SAME, FRESH, OLD, WORD, SEVERE = 0.15, 0.25, -0.35, 0.05, 0.03


def dot(a: str, b: str) -> Column:
    """Inner product in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def asked(vectors: DataFrame) -> DataFrame:
    """The stated query set."""
    return vectors.where(F.col("vec_id") % EVERY == 0)


def index(vectors: DataFrame) -> DataFrame:
    """The index's rows: doc_id, policy_key, clause_id, domain, version, severity and the text that stands for the vector."""
    domain, version = F.col("vec_id") % 3, F.element_at(F.array(*map(F.lit, VERSIONS)), ((F.col("vec_id") / 3).cast("long") % 3 + 1).cast("int"))
    severity = F.when(F.col("label") == 9, "critical").when(F.col("label") == 8, "high").when(F.col("label") >= 4, "medium").otherwise("low")
    rows = vectors.select("vec_id", "label", F.concat(F.lit("d"), domain).alias("domain"), version.alias("version"), F.concat(F.lit("C"), "label").alias("clause_id"), severity.alias("severity"), F.concat(F.lit("tag"), F.col("label") % 4).alias("tag"))
    rows = rows.withColumn("policy_key", F.concat(F.lit("POL-"), F.upper("domain"), F.lit("@"), "version"))
    return rows.select("vec_id", F.concat("policy_key", F.lit("::"), "clause_id").alias("doc_id"), "policy_key", "clause_id", "domain", "version", "severity", "tag", F.concat_ws(" ", "domain", F.concat(F.lit("v"), "version"), "clause_id", "tag").alias("text"))


def cases(vectors: DataFrame) -> DataFrame:
    """The queries' cases: domain, version in force, words (tag and clause) and the key expected."""
    n = (F.col("vec_id") / EVERY).cast("long")
    rows = asked(vectors).select(F.col("vec_id").alias("q"), F.concat(F.lit("d"), n % 3).alias("q_domain"), F.element_at(F.array(*map(F.lit, VERSIONS)), ((n / 3).cast("long") % 3 + 1).cast("int")).alias("in_force"),
                                 F.array(F.concat(F.lit("tag"), n % 4), F.concat(F.lit("C"), "label")).alias("words"), F.concat(F.lit("C"), "label").alias("q_clause"))
    return rows.withColumn("expected", F.concat(F.lit("POL-"), F.upper("q_domain"), F.lit("@"), "in_force"))


def retrieve(vectors: DataFrame, searched: Index, modes: list[str], pool: int = POOL, k: int = K) -> DataFrame:
    """mode, q, rank, the hit's vec_id, policy_key and clause_id, stale, and the case's expected key and clause.

    Pool by similarity, then each mode's filter, rerank and preference, then the cut at k. Filters stay behind the pool, so fewer
    than k may be left. All modes share one search of the vectors' inverted file.
    """
    hits = search(asked(vectors), searched, pool).join(index(vectors).select("vec_id", "policy_key", "clause_id", "domain", "version", "severity", "text"), "vec_id").join(cases(vectors), "q")
    hits = hits.withColumn("same", F.col("domain") == F.col("q_domain")).withColumn("stale", F.col("version") != F.col("in_force"))
    found = F.aggregate("words", F.lit(0), lambda n, w: n + F.contains(F.lower("text"), F.lower(w)).cast("int"))
    boost = F.when(F.col("same"), SAME).otherwise(0.0) + F.when(F.col("stale"), OLD).otherwise(FRESH) + WORD * found + F.when(F.col("severity").isin("high", "critical"), SEVERE).otherwise(0.0)
    known = F.array(*[F.struct(F.lit(m).alias("mode"), *(F.lit(x).alias(n) for x, n in zip(MODES[m], ("dated", "rerank", "soft"), strict=True))) for m in modes])
    hits = hits.withColumn("boost", boost).select("*", F.inline(known)).where("not dated or (same and not stale)")
    hits = hits.withColumn("some", F.max("same").over(Window.partitionBy("mode", "q"))).where("not soft or same or not some")
    order = Window.partitionBy("mode", "q").orderBy(F.desc(F.round(F.col("score") + F.when(F.col("rerank"), F.col("boost")).otherwise(0.0), 6)), "pool")
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("mode", "q", "rank", "vec_id", "policy_key", "clause_id", "stale", "expected", "q_clause")


def case_rows(vectors: DataFrame, searched: Index, modes: list[str]) -> DataFrame:
    """Per mode and query: recall of the expected policy and clause, share of stale hits, reciprocal rank of the expected policy, the first hit's key."""
    right = F.col("policy_key") == F.col("expected")
    hits = retrieve(vectors, searched, modes).groupBy("mode", "q").agg(
        F.max(right.cast("double")).alias("recall_policy"), F.max((F.col("clause_id") == F.col("q_clause")).cast("double")).alias("recall_clause"), F.avg(F.col("stale").cast("double")).alias("stale_rate"),
        (1.0 / F.min(F.when(right, F.col("rank")))).alias("mrr"), F.min(F.when(F.col("rank") == 1, F.col("policy_key"))).alias("top_policy"))
    rows = cases(vectors).select("q", F.col("expected").alias("expected_policy"), F.explode(F.array(*map(F.lit, modes))).alias("mode")).join(hits, ["mode", "q"], "left")
    return rows.select("mode", F.col("q").alias("vec_id"), *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("recall_policy", "recall_clause", "stale_rate", "mrr")), "top_policy", "expected_policy")


def ablation(vectors: DataFrame, searched: Index) -> DataFrame:
    """Per mode the means over all queries."""
    return case_rows(vectors, searched, list(MODES)).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall_policy", "recall_clause", "stale_rate", "mrr")))


def hash_embed(rows: DataFrame, key: str, text: str, dim: int = 256, seed: int = 0) -> DataFrame:
    """Feature hashing as (key, slot, x): words count 1, adjacent pairs 0.5, signs by hash, L2-normalised.

    A text's features are counted and summed where it is read: nothing is exploded or shuffled. Digests of features are kept from text to
    text in a table of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}

        def place(feature: str) -> tuple[int, float]:
            if feature not in known:
                if len(known) >= CACHE:
                    known.clear()
                digest = sha256(f"{seed}:{feature}".encode()).digest()
                known[feature] = int.from_bytes(digest[:4], "little") % dim, 1.0 if digest[4] % 2 == 0 else -1.0
            return known[feature]

        for b in batches:
            sizes, slots, values = [], [], []
            for words in b.column(1).to_pylist():
                x: dict[int, float] = {}
                for weight, features in ((1.0, words or []), (0.5, map("_".join, zip(words or [], (words or [])[1:], strict=False)))):
                    for feature, n in Counter(features).items():
                        slot, sign = place(feature)
                        x[slot] = x.get(slot, 0.0) + weight * sign * n
                kept = [(s, v) for s, v in sorted(x.items()) if v]
                norm = max(1e-8, sqrt(sum(v * v for _, v in kept)))
                sizes.append(len(kept))
                slots += [s for s, _ in kept]
                values += [v / norm for _, v in kept]
            keys = b.column(0).take(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(slots, pa.int64()), pa.array(values, pa.float64())], names=[key, "slot", "x"])

    importable(rows.sparkSession)
    found = rows.select(key, tokens(F.col(text)).alias("t")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, slot long, x double")
    return found.withColumn("x", F.round("x", 6))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean, 0 if both are."""
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def forgetting(runs: DataFrame) -> DataFrame:
    """Forgetting and backward transfer over the stage-by-version matrix of success rates; a cell without runs counts as 0."""
    stage = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    ordinal = F.when(F.col("version") == "1.0", 0).when(F.col("version") == "1.1", 1).otherwise(2)
    cells = runs.groupBy().agg(*[F.coalesce(F.avg(F.when((stage == i) & (ordinal == v), F.when(F.col("success"), 1.0).otherwise(0.0))), F.lit(0.0)).alias(f"c{i}{v}") for i in range(3) for v in range(3)])
    pairs = F.array(*[F.struct(F.col(f"c{v}{v}").alias("x"), F.col(f"c{i}{v}").alias("y")) for v in range(3) for i in range(v + 1, 3)])
    return cells.select(F.explode(pairs).alias("p")).agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("p.x") - F.col("p.y"))), 6).alias("forgetting"), F.round(F.avg(F.col("p.y") - F.col("p.x")), 6).alias("backward_transfer"))


#: Rounds of the bootstrap, a multiple of 16; and 65,536 times the Poisson distribution function (mean 1) at 0, 1, ...
ROUNDS = 208
POISSON = [int(65536 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(7)]


def bootstrap(rows: DataFrame, row: str, key: str, value: str, rounds: int = ROUNDS, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of a mean per key by Poisson resampling: how often a row is drawn in a round comes from four hex digits
    of a SHA-256 of the seed, the round and the row's id, sixteen rounds a digest. Weights are summed in each partition, so a
    (key, round) is one row a partition in the shuffle.
    """
    h = rows.select(key, F.col(value).alias("_x"), row, F.explode(F.sequence(F.lit(0), F.lit(rounds // 16 - 1))).alias("_r"))
    h = h.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), "_r", F.lit(":"), F.col(row).cast("string")), 256))
    u = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.col("_h").substr(4 * i + 1, F.lit(4)), 16, 10).cast("int"))
    drawn = h.select(key, "_x", "_r", F.posexplode(u).alias("_i", "_u"))
    weight = sum((F.col("_u") >= t).cast("int") for t in POISSON)
    means = drawn.withColumn("_w", weight).groupBy(key, (F.col("_r") * 16 + F.col("_i")).alias("_b")).agg(F.round(F.sum(F.col("_w") * F.col("_x")) / F.greatest(F.lit(1), F.sum("_w")), 9).alias("_m"))
    found = means.groupBy(key).agg(F.array_sort(F.collect_list("_m")).alias("_m"))
    return found.select(key, F.element_at("_m", int(alpha / 2 * rounds) + 1).alias("lo"), F.element_at("_m", int((1 - alpha / 2) * rounds)).alias("hi"))
