"""What the operators of this subpackage have in common: session set-up, tables in the shared folder, bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No frame whose size (rows times the row bytes stated by the caller) exceeds this is ever broadcast.
BROADCAST_BYTES = 32 << 20
#: A class with more than a thousandth of all rows is hot; so there are a thousand of them at most.
HOT_SHARE = 1000


def ready(spark: SparkSession, batch_rows: int = 500) -> None:
    """Let Python workers import this package, and keep their Arrow batches small, since one text may be very long.

    Spark has this setting for a whole session only. Plans are lazy, so an operator must be right at any batch size, and those
    whose rows are long cut batches to rows themselves.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary one, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, what: str) -> str:
    """The address of a new folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/palimpsest-{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in a new folder of the shared one and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, what) + "/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, n: int | None = None) -> DataFrame:
    """df with a broadcast hint if its size is proven to be within BROADCAST_BYTES, else df; then Spark shuffles both sides."""
    n = df.count() if n is None else n
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other code point stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows to their class (one row per key in classes, of `size` rows), safe against hot keys.

    Classes with over a thousandth of all rows go by broadcast (a thousand rows at most), all others by shuffle, where
    no key then has more than that share. Null keys match nothing.
    """
    limit = max(HOT_SHARE, total // HOT_SHARE)
    hot, rest = (classes.where(F.col(size) > limit), classes.where(F.col(size) <= limit))
    marked = rows.join(F.broadcast(hot.select(key).withColumn("_hot", F.lit(True))), key, "left")
    return (
        marked.where("_hot").drop("_hot").join(F.broadcast(hot), key, "inner")
        .unionByName(marked.where("_hot is null").drop("_hot").join(rest, key, "left"))
    )


def keep_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs semi- or anti-joined ("left_semi", "left_anti") to ids; the ids are broadcast only if few."""
    return docs.join(bounded(ids.select(key), 64), key, how)


def one_of_each(docs: DataFrame, text: Column, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows in gone, and with one row of each in repeated; all its columns stay, and no others come.

    gone and repeated name rows by doc_id, which may be null, and xx, the XXH64 of `text`; so a document never goes for a
    text that another row of the same doc_id has.
    """
    keyed = docs.withColumn("_row_xx", F.xxhash64(text))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = bounded(keys.select(F.col("doc_id").alias("_key_id"), F.col("xx").alias("_key_xx")), 64)
        return rows.join(keys, rows["doc_id"].eqNullSafe(keys["_key_id"]) & (rows["_row_xx"] == keys["_key_xx"]), how)

    kept = among(keyed, gone, "left_anti")
    if not repeated.isEmpty():
        once = among(kept, repeated, "left_semi").dropDuplicates(["doc_id", "_row_xx"])
        kept = among(kept, repeated, "left_anti").unionByName(once)
    return kept.drop("_row_xx")
