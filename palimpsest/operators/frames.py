"""What operators share: broadcasts behind a size check, tables in the shared folder, imports in Python workers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.files import shared_folder

#: No frame whose size (rows times the row bytes stated by the caller) exceeds this is ever broadcast.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its size is within BROADCAST_BYTES, else df; then Spark shuffles both sides."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def new_folder(spark: SparkSession, what: str) -> str:
    """The address of a new folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/palimpsest-{what}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: computed once, and cut from its lineage."""
    path = new_folder(df.sparkSession, what) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with each row's place in the order, from 1: sorted by ranges, and the rows of the ranges before added to the place in its own."""
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("_before"))
    return part.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") % F.lit(1 << 33) + 1).drop("_at", "_part", "_before")
