"""Token records against the library, and their framing against a bit-by-bit checksum."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import records as R
from palimpsest.llm.queries import op13_token_records, tokenizer

SCHEMA = "doc_id long, text string"


def slow_crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (R.POLYNOMIAL if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksum():
    assert R.crc32c([b"123456789"]).tolist() == [0xE3069283]
    rng = np.random.default_rng(3)
    parts = [rng.bytes(n) for n in (0, 1, 7, 8, 15, 16, 127, 128, 129, 255, 256, 1000, 4097)]
    assert R.crc32c(parts).tolist() == [slow_crc(p) for p in parts]
    assert R.crc32c([]).tolist() == []


def test_frames_say_when_bytes_change():
    ids = [b"", b"\1\0\0\0", b"\2\0\0\0" * 50, b"\xff\xff\0\0\0\0\1\0"]
    made = R.frames([5, None, -1, 0], ids)
    sizes = [len(m) for m in made]
    assert sizes == [28, 30, 128, 36]  # ids of 65536 and more make a record wide
    assert [R._ids(d) for d in R.unframed(b"".join(made), sizes)] == ids
    for at in (0, 9, 20, sizes[0] + 3, sum(sizes) - 1):
        block = bytearray(b"".join(made))
        block[at] ^= 16
        with pytest.raises(ValueError):
            R.unframed(bytes(block), sizes)
    with pytest.raises(ValueError):
        R.unframed(b"".join(made)[:-1], sizes)


def by_hand(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_query_as_the_library(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert [tuple(r) for r in op13_token_records(spark, sf).orderBy("start").collect()] == by_hand(rows)


ROWS = [(3, "one two"), (None, "no id"), (-7, None), (10, ""), (3, "one two"), (11, "<|x|> Tab\tand\nline \u03a3\u03a3 \u00e9"), (12, "long " * 60_000)]


def test_edge_rows_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA + ", ids string, start int").repartition(3)
    R.write_documents(docs, tokenizer("word_bpe_49k.json"), f"file://{tmp_path}/a")
    got = R.digests(R.read_documents(spark, f"file://{tmp_path}/a")).orderBy("start").collect()
    assert [tuple(r) for r in got] == by_hand(ROWS)


def test_empty_table(spark, tmp_path):
    R.write_documents(spark.createDataFrame([], SCHEMA), tokenizer("word_bpe_49k.json"), f"{tmp_path}/a")
    assert R.read_documents(spark, f"{tmp_path}/a").collect() == []


def test_one_id_in_many_ranges_and_small_files(spark, tmp_path):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 700).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range else
    try:
        R.write_documents(docs, tokenizer("word_bpe_49k.json"), f"{tmp_path}/a")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = R.read_documents(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert [r.doc_id for r in plain] == sorted(r.doc_id for r in plain) and len(plain) == 3000
    ends = [r.start + r.n_tokens for r in plain]
    assert [r.start for r in plain] == [0, *ends[:-1]]
    assert len({r.file for r in plain if r.doc_id == 5}) > 1
    spark.createDataFrame([(r.doc_id, bytes(r.ids)) for r in plain], R.WRITTEN).coalesce(1).write.format("token_records").mode("append").option("file_bytes", 5000).save(f"{tmp_path}/b")
    small = R.read_documents(spark, f"{tmp_path}/b", slice_bytes="900")
    assert len({r.file for r in small.collect()}) > 5 and small.rdd.getNumPartitions() > 20
    assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in small.collect()) == sorted((r.doc_id, r.start, bytes(r.ids)) for r in plain)


def test_shuffled_reads_have_all_records_in_another_order(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    R.write_documents(docs, tokenizer("word_bpe_49k.json"), f"{tmp_path}/a")
    plain, one, two, again = ([r.doc_id for r in R.read_documents(spark, f"{tmp_path}/a", slice_bytes="4000", **o).collect()] for o in ({}, {"seed": "1"}, {"seed": "2"}, {"seed": "1"}))
    assert sorted(one) == sorted(two) == sorted(plain) == list(range(500))
    assert one == again and one != two and one != plain


def test_files_that_no_manifest_names_do_not_count(spark, tmp_path):
    docs = spark.createDataFrame(ROWS[:3], SCHEMA)
    R.write_documents(docs, tokenizer("word_bpe_49k.json"), f"{tmp_path}/a")
    with open(f"{tmp_path}/a/part-000000-0000-of-a-lost-task.rec", "wb") as f:
        f.write(os.urandom(100))
    assert R.read_documents(spark, f"{tmp_path}/a").count() == 3


def test_damaged_file_is_an_error(spark, tmp_path):
    R.write_documents(spark.createDataFrame(ROWS[:3], SCHEMA).coalesce(1), tokenizer("word_bpe_49k.json"), f"{tmp_path}/a")
    name = next(n for n in os.listdir(f"{tmp_path}/a") if n.endswith(".rec"))
    with open(f"{tmp_path}/a/{name}", "r+b") as f:
        f.seek(14)
        f.write(b"\xff")
    with pytest.raises(Exception, match="checksums"):
        R.read_documents(spark, f"{tmp_path}/a").collect()
