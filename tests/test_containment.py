"""Containment by characters against Python's `in`, and what the fingerprints promise."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fingerprints as P
from palimpsest.operators import containment

CLAUSE = "Every decision of the domain is kept on record for ten years"


def contained(spark, clauses, texts):
    c = spark.createDataFrame([(i, x) for i, x in enumerate(clauses)], "k long, text string")
    t = spark.createDataFrame([(x, 1) for x in texts], "text string, k int").repartition(3)
    return [r.contained for r in containment.contained(c, "k", t).orderBy("k").collect()]


def test_shared_runs_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for gram, window in ((16, 25), (8, 13), (4, 5), (1, 1), (5, 3)):
        for _ in range(60):
            run = rng.integers(0, 256, gram + window - 1, dtype=np.uint8)
            texts = [np.concatenate((rng.integers(97, 100, rng.integers(0, 90), dtype=np.uint8), run, rng.integers(97, 100, rng.integers(0, 90), dtype=np.uint8))) for _ in range(3)]
            offsets = np.cumsum([0] + [len(t) for t in texts])
            text, fps = P.winnowed(np.concatenate(texts), offsets, gram, window)
            sets = [set(fps[text == i].tolist()) for i in range(3)]
            assert sets[0] & sets[1] & sets[2]
            own = [P.winnowed(t, np.array([0, len(t)]), gram, window)[1].tolist() for t in texts]  # a text's neighbours play no part
            assert [sorted(s) for s in sets] == own


def test_hashes_depend_on_the_gram_alone():
    data = np.frombuffer(b"abcabcabcd", dtype=np.uint8)
    for gram in (1, 2, 3, 5, 7):
        h = P.gram_hashes(data, gram)
        assert len(h) == len(data) - gram + 1
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(bytes(data[i : i + gram]), x) == x
        assert len(set(seen.values())) == len(seen)
    assert len(P.gram_hashes(data[:2], 3)) == 0


@pytest.mark.parametrize("around", ["{}", "{}.", "({})", "x{}x", '"{}"', "{} and more", "before {}, after", "\n{}\n", "é{}é"])
def test_a_clause_is_found_whatever_stands_beside_it(spark, around):
    other = CLAUSE.replace("ten", "six")
    assert contained(spark, [CLAUSE, other], [around.format(CLAUSE), "no clause here", None, ""]) == [True, False]


def test_a_clause_within_json(spark):
    row = json.dumps({"messages": [{"role": "system", "text": CLAUSE}], "n": 1})
    assert contained(spark, [CLAUSE, CLAUSE[5:45], CLAUSE + "."], [row]) == [True, True, False]


def test_random_clauses_as_python(spark):
    rng = np.random.default_rng(2)
    alphabet = list("ab é.\"\n") + ["word ", "clause"]
    texts = ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(0, 200))) for _ in range(120)]
    clauses = ["", None, "é", texts[3], texts[3] + "!", "Z"]
    for n in (1, 5, 7, 8, 15, 20, 39, 40, 41, 80):
        for t in texts[:25]:
            at = int(rng.integers(0, max(1, len(t) - n)))
            clauses += [t[at : at + n], t[at : at + n // 2] + "#" + t[at + n // 2 : at + n]]
    want = [bool(c) and any(c in t for t in texts) for c in clauses]
    assert contained(spark, clauses, texts) == want and 100 < sum(want) < len(want) - 100


def test_repeated_and_null_keys_and_many_alike(spark):
    # Clauses of one template meet only the texts that have their own part.
    c = spark.range(300).select((F.col("id") % 7).alias("k"), F.format_string("Under rule %05d every decision of the domain is kept on record", "id").alias("text"))
    c = c.union(spark.createDataFrame([(None, "Under rule 00007 every decision of the domain is kept on record")], "k long, text string"))
    t = spark.range(0, 300, 2).select(F.format_string("See: Under rule %05d every decision of the domain is kept on record.", "id").alias("text"))
    got = containment.contained(c, "k", t).collect()
    assert len(got) == 301 and sum(r.contained for r in got) == 150
    assert [r.contained for r in got if r.k is None] == [False]


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k long, text string")
    some = spark.createDataFrame([(1, CLAUSE)], "k long, text string")
    assert containment.contained(none, "k", some).collect() == []
    assert [tuple(r) for r in containment.contained(some, "k", none).collect()] == [(1, False)]
