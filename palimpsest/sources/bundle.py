"""Bundles of data sets: written aside, digested, listed in a manifest, and put in force by one rename.

`root/name` holds a folder for each version and the file CURRENT, which names the version in force. A version's files come first, then
its manifest with their digests, and last CURRENT by a rename that replaces it. So whoever is stopped in between leaves the version
before in force, and whoever reads sees the one or the other. A stamp says that a version was validated; it stands in the version's
folder and holds the manifest's digest, so a new version has none and a changed file makes it stale.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, MANIFEST, STAMP = "CURRENT", "manifest.json", "stamp.json"


class Files:
    """Small files and renames on whatever file system an address is on."""

    def __init__(self, spark: SparkSession, at: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(at).getFileSystem(self.conf)

    def path(self, at: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def exists(self, at: str) -> bool:
        return self.fs.exists(self.path(at))

    def read(self, at: str) -> str:
        stream = self.fs.open(self.path(at))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, at: str, text: str) -> None:
        stream = self.fs.create(self.path(at), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """One rename, also over a file that is there."""
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        options[0] = overwrite
        where = self.fs.makeQualified(self.path(target))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf).rename(self.fs.makeQualified(self.path(source)), where, options)


def digests(spark: SparkSession, version: str) -> DataFrame:
    """part, file, n_bytes, sha256 of every data file below a version's folder, empty ones but markers included."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(version)
    names = F.split("path", "/")
    rows = rows.select(F.element_at(names, -2).alias("part"), F.element_at(names, -1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~F.col("file").isin(MANIFEST, STAMP) | (F.col("part") != version.rstrip("/").rsplit("/", 1)[-1]))


def _listed(rows: DataFrame) -> list[dict]:
    return [r.asDict() for r in rows.orderBy("part", "file").collect()]  # a row for each file


def _digest(files: list[dict]) -> str:
    return hashlib.sha256(json.dumps(files, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_bundle(spark: SparkSession, root: str, name: str, parts: dict[str, tuple[DataFrame, Callable[[DataFrame, str], None]]], config: dict | None = None, reached: Callable[[str], None] = lambda step: None) -> str:
    """Write a new version of a bundle, each part by its sink, and put it in force; its folder. `reached` is told of each step that is done."""
    base = f"{root}/{name}"
    version = f"{base}/{uuid.uuid4().hex}"
    for part, (frame, sink) in parts.items():
        sink(frame, f"{version}/{part}")
        reached(f"part {part}")
    files = _listed(digests(spark, version))
    there = Files(spark, root)
    there.write(f"{version}/{MANIFEST}", json.dumps({"name": name, "config": config or {}, "files": files, "digest": _digest(files)}, sort_keys=True))
    reached("manifest")
    draft = f"{version}/{POINTER}"
    there.write(draft, version.rsplit("/", 1)[-1])
    reached("draft")
    there.replace(draft, f"{base}/{POINTER}")
    reached("published")
    return version


def current(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder of the version in force, or None."""
    there, at = Files(spark, root), f"{root}/{name}/{POINTER}"
    return f"{root}/{name}/{there.read(at)}" if there.exists(at) else None


def manifest(spark: SparkSession, version: str) -> dict:
    return json.loads(Files(spark, version).read(f"{version}/{MANIFEST}"))


def changes(spark: SparkSession, version: str) -> DataFrame:
    """part, file, event (missing_file, unknown_file, hash_changed) for each file that isn't as the manifest says; the files are hashed again."""
    said = spark.createDataFrame([(f["part"], f["file"], f["sha256"]) for f in manifest(spark, version)["files"]], "part string, file string, said string")
    both = said.join(digests(spark, version).select("part", "file", "sha256"), ["part", "file"], "full")
    event = F.when(F.col("sha256").isNull(), "missing_file").when(F.col("said").isNull(), "unknown_file").when(F.col("said") != F.col("sha256"), "hash_changed")
    return both.select("part", "file", event.alias("event")).where("event is not null")


def stamp(spark: SparkSession, version: str, events: DataFrame) -> None:
    """Stamp a version that its validation found no events in; else it is an error, and nothing is written."""
    found = [r[0] for r in events.where("n > 0").select("event").limit(20).collect()]
    if found:
        raise ValueError(f"not validated: {', '.join(sorted(found))}")
    Files(spark, version).write(f"{version}/{STAMP}", json.dumps({"passed": True, "digest": manifest(spark, version)["digest"]}))


def require_stamp(spark: SparkSession, root: str, name: str) -> str:
    """The folder of the version in force, if it is stamped and its files are those that were stamped; else it is an error."""
    version = current(spark, root, name)
    if version is None:
        raise ValueError(f"no bundle: {name}")
    there = Files(spark, version)
    if not there.exists(f"{version}/{STAMP}"):
        raise ValueError(f"missing stamp: {name}")
    if json.loads(there.read(f"{version}/{STAMP}"))["digest"] != _digest(_listed(digests(spark, version))):
        raise ValueError(f"changed since it was stamped: {name}")
    return version
