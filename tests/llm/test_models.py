"""Codec, language, toxicity and licences on small inputs."""

import hashlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from palimpsest.llm import language_id as L
from palimpsest.llm import licenses, toxicity
from palimpsest.llm.piece_codec import START, PieceTable, coded
from palimpsest.llm.queries import tokenizer

SCHEMA = "doc_id long, text string"


def test_codec_equals_library(spark, sf):
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + [None, "", " ", "  a  b ", "▁x", "<s> <0x0A>", "日本🙂", "a\x00b", "x" * 2000]
    got = {r.doc_id: r for r in coded(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert tuple(got[i])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))), t


def test_codec_equals_library_on_a_whole_table(spark):
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3)).withColumn("n_tokens", docs["doc_id"])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    assert sorted(map(tuple, coded(docs, path).collect())) == sorted(want)
    assert coded(docs.limit(0), path).count() == 0


def test_codec_odd_texts_one_by_one_and_together():
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(1)
    letters = ["a", "e", "é", "日", "\U0001f642", " ", "\u2581", "\x00", "\n", "th", "ing", "\u0e01", "\U00020000", "0", "__"]
    texts = ["".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(1, 60)))) for _ in range(1500)] + ["ab" * 3000, "\U0001f642" * 2000, " " * 300]
    t = PieceTable(path)
    for x, words in zip(texts, t.encode_all(texts), strict=True):
        assert ",".join(words) == ",".join(map(str, sp.encode(x))), repr(x)
        assert t.decode(words) == sp.decode(sp.encode(x))
        assert ",".join(words) == ",".join(t[w] for w in t.words(x))


def test_pair_tests_as_merging_anew():
    t = PieceTable(tokenizer("piece_bpe_32k.model"))
    rng, pieces = np.random.default_rng(2), [*t.piece]
    for a, b in rng.choice(pieces, (4000, 2)).tolist():
        assert t.compatible(a, b) == (t.merged(t.piece[a] + t.piece[b])[0] == [t.piece[a], t.piece[b]])
    for b in pieces:
        assert t.compatible(START, b) == (t.merged(t.piece[b])[0] == [t.piece[b]])


def test_language(spark):
    words = {"aa": "alpha beta gamma delta ", "bb": "zwö drü fööf süben "}
    rows = [(i, words[k] * (5 + i % 7), k) for i in range(60) for k in [("aa", "bb")[i % 2]]] + [(900, None, "aa"), (901, "123 !", "bb"), (902, words["aa"], None), (None, words["bb"], "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(docs, L.train(docs)).collect()}
    assert all(got[i].lang_pred == k for i, t, k in rows[:60]) and got[900].lang_pred == got[901].lang_pred == "und"
    assert got[902].lang_pred == "aa" and got[None].lang_pred == "bb" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0
    kept = L.keep_identified(docs, L.train(docs))
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901)").count() == 0


def test_tables_equal_the_direct_network(spark):
    """Predictions from tables against convolution, maximum and softmax written out."""
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh ñß"), 300)) for _ in range(12)]
    words = {"aa": "alpha beta gamma delta ", "bb": "zwö drü fööf süben ", "cc": "uno due tre quattro "}
    rows = [(i, words[k] * (5 + i % 7), k) for i in range(90) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = [r.doc_id for r in docs.where(L.in_training()).collect()]
    assert learned and all(__import__("zlib").crc32(str(i).encode()) % 3 != 1 for i in learned)
    net = L.train(docs)
    held = L.identify(docs, net).where("held_out")
    assert held.count() == len(rows) - len(learned) and held.join(docs, "doc_id").where("lang <> lang_pred").count() == 0
    assert [x for x, _ in net.predict_all(texts)] == [x for t in texts for x, _ in net.predict_all([t])]
    x, _ = L.windows([t.encode() for t in texts])
    emb, span, pooled = net.p["e"][x], x.shape[1] - 3, []
    for w in L.WIDTHS:  # at the places that all widths have
        pooled.append(sum(emb[:, j : j + span] @ net.p[f"w{w}"][j] for j in range(w)).max(1))
    logit = np.maximum(np.concatenate(pooled, 1) + net.p["b"], 0) @ net.p["d"] + net.p["c"]
    direct = logit - np.log(np.exp(logit - logit.max(1, keepdims=True)).sum(1, keepdims=True)) - logit.max(1, keepdims=True)
    assert np.allclose(net.log_probabilities(x), direct, atol=1e-3)
    many = spark.createDataFrame([(i, f"w{i % 80}x " * 30, f"l{i % 80}") for i in range(800)], "doc_id long, text string, lang string")
    assert len(L.train(many, per_language=4, most=240).languages) == 80


def test_toxicity(spark):
    rows = [(i, "a plain text of words " + "awful nasty " * (i % 3 if i % 4 == 0 else 0)) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int("awful" in t)) for i, t in rows[:200]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.grade(docs, toxicity.train(docs, labels)).collect()}
    assert all(got[i].toxic == ("awful" in t) for i, t in rows[:200]) and not got[900].toxic and not got[901].toxic
    none = toxicity.grade(docs, toxicity.train(docs, labels.limit(0)))
    assert none.where("expected_severity <> 0 or toxic").count() == 0


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "some longer text before it\nReleased under the MIT License.\nand more words after it"), (4, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (5, "the MIT of License"), (3, "some longer text before it\nReleased under the MIT License.\nand more words after it")]
    got = sorted(tuple(r)[:3] for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got[0] == (1, 0, "") and got[2] == got[3] == (3, 1, "mit") and got[4] == (4, 3, "cc-by-nc-4.0,reserved") and got[5] == (5, 0, "")


def dice(texts, templates=licenses.TEMPLATES):
    """The best coefficient of each text's units, by comparing all to all."""
    import re

    out = []
    for t in texts:
        low = re.sub("[^a-z0-9\n]+", " ", (t or "").lower())
        units = low.split("\n") + [p for p in re.split("\n *\n", low) if "\n" in p] + ([low] if re.search("\n *\n", low) else [])
        found = []
        for u in units:
            w = re.split("[ \n]", u)
            w = [x for x in w if x]
            g = set(zip(w, w[1:]))
            each = [(-2 * len(g & {tuple(x.split()) for x in m}) / (len(g) + len(m)), n) for n, m in licenses.template_bigrams(templates)]
            each = [x for x in each if x[0] <= -licenses.THRESHOLD]
            found += [min(each)] if each else []
        out.append((len(found), ",".join(sorted({n for _, n in found})), min(found)[1] if found else "", -min(found)[0] if found else 0.0))
    return out


def test_licences_as_brute_force(spark):
    mit = max(licenses.TEMPLATES["mit"], key=len)
    lines = "\n".join(mit.split(". "))
    texts = [None, "", "all rights reserved " * 60, "all rights reserved " * 70, "All Rights Reserved " * 4000, mit, lines, mit.replace(". ", ".\n\n"), "word " * 20000 + "\nReleased under the MIT License.", "released under license mit", "permission " * 50]
    rng = np.random.default_rng(3)
    for _ in range(60):  # templates with words left out, around the threshold
        name = list(licenses.TEMPLATES)[int(rng.integers(len(licenses.TEMPLATES)))]
        w = licenses.TEMPLATES[name][int(rng.integers(len(licenses.TEMPLATES[name])))].split()
        texts.append(" ".join(x for x in w if rng.random() > 0.07))
    rows = [*enumerate(texts), (2, texts[2])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("best", F.lit(1))
    got = sorted((r.doc_id, r.n_matches, r.licenses, r.best, round(r.best_dice, 12)) for r in licenses.scan(df).collect())
    want = sorted((i, *x[:3], round(x[3], 12)) for (i, _), x in zip(rows, dice([t for _, t in rows])))
    assert got == want and dict(enumerate(dice(texts)))[3][1] == "reserved"
    assert licenses.scan(df.limit(0)).count() == 0
