"""A training corpus from documents: each stage works on all that the one before it kept.

language: documents whose language the byte network doesn't know go. exact: of equal texts one row of the largest doc_id stays.
near: of near copies (covering SimHash finds them, a Jaccard similarity of five-word shingle sets of 0.8 or more confirms them) one
row of the smallest doc_id stays. secrets: found parts are masked in the text. pack: token pieces packed into sequences; only this
stage returns other columns than those of documents.

Defined results: null texts have no language and go in the first stage; rows with null doc_id take part, and of copies without any
id one stays; repeated rows are copies; a doc_id that occurs with several texts keeps each of them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import exact_dedup, language_id, near_copies, packing, secrets
from palimpsest.llm._shared import stored
from palimpsest.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with a known language."""
    return language_id.keep_identified(docs, language_id.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without exact copies."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents without near copies."""
    return near_copies.drop_similar(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of documents in sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", mask), ("pack", pack)]

#: A trained network, fingerprint components and bin packing have no SQL form; the tests compare the whole to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
