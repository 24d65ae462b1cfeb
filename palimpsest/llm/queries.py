"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import divergence, licenses
from palimpsest.llm._shared import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.topk import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.toxicity import grade, train

    docs = _table(spark, sf_dir, "documents")
    return grade(docs, train(docs, _table(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.suffix_dedup import cut_repeats

    return cut_repeats(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.piece_codec import coded

    return coded(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.periodic_runs import find_runs

    return find_runs(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palimpsest.llm.records import digests, read_documents, write_documents

    path = new_folder(spark, "records")
    write_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path)
    return digests(read_documents(spark, path))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_simhash, op3_toxicity, op4_suffix_dedup, op5_license_scan, op6_piece_codec, op7_topk, op8_packing, op9_secrets, op10_exact_dedup, op11_periodic_runs, op12_source_divergence, op13_token_records)}

ORACLES = {
    "op5_license_scan": licenses.oracle(),
    "op12_source_divergence": divergence.oracle(),
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
}
