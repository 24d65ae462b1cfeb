"""JSON, JSON lines and CSV in and out, with manifests. Reads and writes go through Spark, so any of its file systems will do."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions.json_schema import schema_of


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A document that is an object or a list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, versions: list[str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """A row per line, blank lines skipped; then only the versions asked for (rows without one go), then the first rows by order."""
    df = spark.read.schema(schema).json(path)
    if versions is not None:
        df = df.where(F.col("policy_version").isin(versions))
    if limit is not None:
        df = (df.orderBy(order) if order else df).limit(limit)
    return df


TRAINING = "case_id long, text string, messages array<struct<role:string,content:string>>, policy_version string, metadata struct<policy_version:string>"


def read_training(spark: SparkSession, path: str, versions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """case_id, text, policy_version of training rows: the text, or where it is empty the last message's; the version, or where it is null that of the metadata.

    Only the versions asked for, then the first rows by case_id. No row at all is an error.
    """
    df = spark.read.schema(TRAINING).json(path)
    last = F.get("messages", F.size("messages") - 1)["content"]
    df = df.select("case_id", F.coalesce(F.when(F.col("text") != "", F.col("text")), last, F.lit("")).alias("text"), F.coalesce("policy_version", "metadata.policy_version").alias("policy_version"))
    if versions is not None:
        df = df.where(F.col("policy_version").isin(versions))
    if limit is not None:
        df = df.orderBy("case_id").limit(limit)
    if df.isEmpty():
        raise ValueError(f"no training rows: {path}")
    return df


def read_directory(spark: SparkSession, root: str, schema: StructType | str, key: list[str]) -> DataFrame:
    """All JSON documents under root but schemas; of equal keys the last path wins."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(root).withColumn("_path", F.col("_metadata.file_path"))
    df = df.where(~F.col("_path").endswith(".schema.json") & ~F.col("_path").contains("/schemas/"))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_path")))).where("_n = 1").drop("_n", "_path")


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One object per line; partitioned by columns if given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in this order, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def json_schema(df: DataFrame) -> dict:
    """The JSON Schema of the frame's rows."""
    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | schema_of(df.schema, False)


def manifest(df: DataFrame, name: str) -> DataFrame:
    """Rows and an order-free checksum of a data set."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")


def clip(json: Column, most: int = 200_000) -> Column:
    """A JSON text of at most `most` characters as it is; a larger one becomes a stub that gives its size."""
    return F.when(F.length(json) > most, F.to_json(F.struct(F.lit(True).alias("truncated"), F.length(json).alias("size")))).otherwise(json)


def clipped(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Each row as JSON, clipped."""
    return df.select(clip(F.to_json(F.struct(*df.columns)), most).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """One document, a list of objects in each part file."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_listed, "value string").write.mode("overwrite").text(path)


def _listed(batches):  # noqa: ANN001, ANN202
    import pyarrow as pa

    first = True
    for b in batches:
        for v in b.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict({"value": [("[" if first else ",") + v]})
            first = False
    if not first:
        yield pa.RecordBatch.from_pydict({"value": ["]"]})


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A configuration file, which must hold a mapping (an empty one counts as an empty mapping). It is read through Spark, so any of its file systems will do."""
    import yaml

    texts = spark.read.text(path, wholetext=True).take(2)
    if len(texts) > 1:
        raise ValueError(f"several files: {path}")
    data = yaml.safe_load(texts[0][0]) if texts else None
    if not isinstance(data or {}, dict):
        raise ValueError(f"no mapping: {path}")
    return data or {}


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """folder, n_files, n_bytes, sha256 (of the folder's files' digests, or of its only file) and names for each folder below root; hidden and empty files don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where("length > 0")
    part = F.split("path", "/")
    files = files.select(F.element_at(part, -2).alias("folder"), F.element_at(part, -1).alias("name"), "length", F.sha2("content", 256).alias("sha"))
    found = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("name", "sha"))).alias("a"))
    return found.select("folder", "n_files", "n_bytes", F.when(F.col("n_files") == 1, F.col("a")[0]["sha"]).otherwise(F.sha2(F.concat_ws("", F.col("a.sha")), 256)).alias("sha256"), F.col("a.name").alias("names"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary one, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext.getCheckpointDir()
