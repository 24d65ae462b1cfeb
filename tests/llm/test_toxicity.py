"""The ordinal regression: its gradient, the order of thresholds, what it finds in documents it never saw, and edge rows."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import toxicity as T

SCHEMA = "doc_id long, text string"


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    n, k = 30, 6
    dense = rng.integers(0, 3, (n, k))
    doc, col = np.nonzero(dense)
    rows, val = (doc, col, np.log1p(dense[doc, col])), np.log1p(dense)
    over = (rng.integers(0, 4, n)[:, None] > np.arange(3)).astype(float)
    p = {"w": rng.normal(size=k), "t": np.array([0.3, -0.2, 0.4])}
    loss, g = T.Ordinal.loss(p, rows, over, 0.1)
    # The loss itself, densely, from its definition.
    cuts = np.cumsum([p["t"][0], *np.exp(p["t"][1:])])
    prob = 1 / (1 + np.exp(-(val @ p["w"][:, None] - cuts[None])))
    direct = -((over * np.log(prob) + (1 - over) * np.log(1 - prob)) * T.LEVELS).sum() / n + 0.1 * (p["w"] ** 2).sum() / (2 * n)
    assert abs(loss - direct) < 1e-12
    for name in p:
        for i in range(len(p[name])):
            q = {m: a.copy() for m, a in p.items()}
            q[name][i] += 1e-6
            assert abs((T.Ordinal.loss(q, rows, over, 0.1)[0] - loss) / 1e-6 - g[name][i]) < 1e-5


def test_thresholds_ascend_and_severity_is_expected():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 400)
    rows = [{0: int(g), 1: int(rng.integers(1, 3))} if g else {1: int(rng.integers(1, 3))} for g in grades]
    model = T.Ordinal.fit(["bad", "word"], rows, grades)
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] > abs(model.weights[1])
    found = [model.severity("bad " * g) for g in range(4)]
    assert [g for _, g in found] == sorted(g for _, g in found) and all(a[0] < b[0] for a, b in zip(found, found[1:]))
    z = model.weights[0] * np.log1p(2) - model.thresholds
    assert abs(found[2][0] - (1 / (1 + np.exp(-z))).sum()) < 1e-9


def test_severity_follows_the_share_of_sentences_not_the_length(spark):
    rows = []
    for i in range(600):
        bad = [0, 0, 1, 4, 20][i % 5]
        sentences = ["awful nasty things"] * bad + ["plain calm words"] * (40 - bad)
        rows.append((i, ". ".join(sentences * (1 + i % 2)), bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad int")
    model = T.train(docs, docs.select("doc_id", (F.col("bad") > 0).cast("int").alias("toxic")))
    by = {}
    for r in T.grade(docs, model).join(docs, "doc_id").collect():
        by.setdefault(r.bad, []).append(r.expected_severity)
        assert r["toxic"] == (r.bad > 0)
    means = [np.mean(by[b]) for b in (0, 1, 4, 20)]
    assert means == sorted(means) and means[3] - means[1] > 0.5


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    known = docs.join(labels.where("toxic is not null"), "doc_id")
    model = T.train(docs.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 <> 0"))
    rows = T.grade(known.where("doc_id % 4 = 0").select("doc_id", "text"), model).join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").groupBy("label").agg(F.avg(F.col("toxic").cast("int")).alias("flagged")).collect()
    flagged = {r.label: r.flagged for r in rows}
    assert flagged[1] > 0.88 and flagged[0] < 0.01, flagged


def test_edge_rows(spark):
    rows = [(i, "plain words here " + ("awful nasty " if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = T.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    edge = [(900, None), (901, ""), (None, "awful"), (902, "plain " * 200_000 + "awful nasty"), (903, "awful nasty"), (903, "awful nasty"), (904, "AWFUL NASTY")]
    got = T.grade(spark.createDataFrame([(*r, True, 5) for r in edge], SCHEMA + ", toxic boolean, grade int").repartition(2), model).collect()
    assert len(got) == len(edge) and got[0].__fields__ == ["doc_id", "expected_severity", "grade", "toxic"]
    of = {r.doc_id: r for r in got}
    assert not of[900].toxic and of[900].expected_severity == of[901].expected_severity and of[902].toxic and of[None].expected_severity > of[901].expected_severity
    assert of[903].expected_severity == of[904].expected_severity and sum(r.doc_id == 903 for r in got) == 2
    assert T.grade(docs.limit(0), model).collect() == [] and not len(T.train(docs.limit(0), docs.limit(0).withColumn("toxic", F.lit(1))).weights)
