"""The whole pipeline against its stages done by brute force on one machine."""

import zlib

import numpy as np
import pytest
from test_dedup import low
from test_near_copies import kept

import corpus_pipeline
from palimpsest.llm import language_id
from palimpsest.llm.queries import tokenizer
from palimpsest.llm.secrets import masked


def brute(spark, docs):
    """(doc_id, piece, start, length, ids_crc32) of the pieces, for unique non-null doc_ids."""
    from tokenizers import Tokenizer

    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    net = language_id.train(docs)
    said = [net.predict([t])[0] for _, t in rows]
    rows = [r for r, (lang, score) in zip(rows, said) if lang != "und" and score >= 0.4]
    last = {low(t): d for d, t in rows}  # ids ascend, so the largest of each text stays
    rows = [(d, t) for d, t in rows if last[low(t)] == d]
    stay = set(kept(rows))
    whole = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    out = []
    for d, t in rows:
        if d in stay:
            ids = [*whole.encode(masked(t) or "", add_special_tokens=False).ids, 0]
            for n, at in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[at : at + 2048], dtype="<u4")
                out.append((d, n, at, len(part), zlib.crc32(part.tobytes())))
    return sorted(out)


def test_stages_and_result(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "secrets", "pack"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(spark, docs)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_stages_keep_the_columns(spark, sf, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.schema.simpleString() == spark.read.parquet(f"{sf}/documents.parquet").schema.simpleString()


def test_empty_null_and_repeated(spark, sf, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
    some = docs.orderBy("doc_id").limit(60)
    nulls = docs.where("doc_id = 70").selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    some.unionByName(some.limit(5)).unionByName(nulls).unionByName(nulls).write.parquet(f"{folder}/odd/documents.parquet")
    pieces = corpus_pipeline.run(spark, f"{folder}/odd").collect()
    firsts = [r.doc_id for r in pieces if r.piece == 0]
    assert len(firsts) == len(set(firsts)) <= 61
