"""Which of many clauses stand, character for character, in any of many texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.fingerprints import fingerprints
from palimpsest.operators.frames import bounded, importable, stored

#: Least bytes of a clause and bytes of a gram: a clause is looked for by the longest class it reaches.
CLASSES = [(40, 16), (20, 8), (8, 4), (1, 1)]


def _class(n: Column) -> Column:
    return F.coalesce(*[F.when(n >= least, gram) for least, gram in CLASSES])


def _keyed(rows: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """key, gram, fps of rows (key, text)."""
    importable(rows.sparkSession)
    return rows.mapInArrow(fingerprints([(gram, least - gram + 1) for least, gram in classes]), "key long, gram int, fps array<long>")


def contained(clauses: DataFrame, key: str, texts: DataFrame, text: str = "text", row_bytes: int = 4096) -> DataFrame:
    """Each row of clauses (key, text) with `contained`: whether its text stands in any text, as `contains` says.

    A clause meets a text by one winnowed fingerprint, which every text that holds the clause must have: of the clause's own the one
    that fewest clauses share. Only numbers are exploded and joined; then the few texts that were met are compared. A clause of under
    40 bytes meets texts by shorter grams, one of under 8 by a single byte.

    row_bytes is what a clause's text may take on average. Null and empty clauses and texts hold nothing; keys may be repeated or null.
    """
    own = clauses.select(F.col(key).alias("k"), F.col(text).alias("c")).where("c <> ''").select("k", "c", F.xxhash64("c").alias("key"))
    wanted = own.select("key", "c").dropDuplicates(["key", "c"]).withColumn("want", _class(F.octet_length("c")))
    used = {r[0] for r in wanted.select("want").distinct().collect()}  # four values at most
    classes = [(least, gram) for least, gram in CLASSES if gram in used]
    if not classes:
        return clauses.select(key, F.lit(False).alias("contained"))
    grams = _keyed(wanted.select("key", F.col("c").alias("text")), classes).select("key", F.col("gram").alias("want"), F.explode("fps").alias("fp"))
    grams = grams.join(wanted.select("key", "want").distinct(), ["key", "want"], "left_semi")
    shared = grams.groupBy("want", "fp").agg(F.count(F.lit(1)).alias("n"))
    anchors = grams.join(shared, ["want", "fp"]).groupBy("key", "want").agg(F.min(F.struct("n", "fp"))["fp"].alias("fp"))
    anchors = stored(anchors, "anchors")
    some = texts.select(F.col(text).alias("t")).where("t <> ''").withColumn("h", F.xxhash64("t"))
    fps = _keyed(some.select(F.col("h").alias("key"), F.col("t").alias("text")), classes).select(F.col("key").alias("h"), F.col("gram").alias("want"), F.explode("fps").alias("fp"))
    met = stored(fps.join(bounded(anchors, 32), ["want", "fp"]).select("h", "key").distinct(), "met")
    pairs = some.join(bounded(met, 32), "h").join(bounded(wanted.select("key", "c"), row_bytes), "key")
    hits = pairs.where(F.contains("t", "c")).select("key", F.xxhash64(F.lit(0), "c").alias("check")).distinct()
    hits = clauses.select(F.col(key), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(0), F.col(text)).alias("check")).join(hits.withColumn("_hit", F.lit(True)), ["key", "check"], "left")
    return hits.select(key, F.col("_hit").isNotNull().alias("contained"))
