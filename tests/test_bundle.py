"""Bundles: either the old or the new one is in force, whenever the writer is stopped; stamps go stale with any change."""

import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import bundle as B
from palimpsest.sources import files as S

STEPS = ["part rows", "part table", "manifest", "draft", "published"]


def parts(spark, n):
    df = spark.range(n).withColumn("v", F.lit("é"))
    return {"rows": (df.repartition(2), S.write_jsonl), "table": (df, lambda d, p: S.write_csv(d, p, ["v", "id"]))}


def rows(spark, version):
    return spark.read.schema("id long").json(f"{version}/rows").count()


@pytest.mark.parametrize("stop", STEPS)
def test_stopped_at_any_step(spark, tmp_path, stop):
    root = f"file://{tmp_path}"
    old = B.write_bundle(spark, root, "set", parts(spark, 5), {"seed": 1})

    def reached(step):
        if step == stop:
            raise KeyboardInterrupt(step)

    with pytest.raises(KeyboardInterrupt):
        B.write_bundle(spark, root, "set", parts(spark, 9), reached=reached)
    now = B.current(spark, root, "set")
    assert (now == old) == (stop != "published")
    assert rows(spark, now) == (5 if now == old else 9) and B.changes(spark, now).count() == 0
    assert rows(spark, B.write_bundle(spark, root, "set", parts(spark, 7))) == 7 and B.current(spark, root, "set") not in (old, now)


def test_manifest_and_changes(spark, tmp_path):
    version = B.write_bundle(spark, str(tmp_path), "set", parts(spark, 5), {"seed": 1})
    said = B.manifest(spark, version)
    assert said["config"] == {"seed": 1} and {f["part"] for f in said["files"]} == {"rows", "table"}
    of = {p: [f["file"] for f in said["files"] if f["part"] == p] for p in ("rows", "table")}
    assert len(of["rows"]) == 2
    with open(f"{version}/rows/{of['rows'][0]}", "a") as f:
        f.write("{}\n")
    os.remove(f"{version}/rows/{of['rows'][1]}")
    with open(f"{version}/table/more.csv", "w") as f:
        f.write("x")
    for p, _, names in os.walk(version):  # checksums of the local file system
        for n in names:
            if n.endswith(".crc"):
                os.remove(f"{p}/{n}")
    assert {(r.part, r.event) for r in B.changes(spark, version).collect()} == {("rows", "hash_changed"), ("rows", "missing_file"), ("table", "unknown_file")}


def test_stamps(spark, tmp_path):
    root = str(tmp_path)
    events = lambda n: spark.createDataFrame([("case_id_overlap", n), ("other", 0)], "event string, n long")
    with pytest.raises(ValueError, match="no bundle"):
        B.require_stamp(spark, root, "set")
    version = B.write_bundle(spark, root, "set", parts(spark, 5))
    with pytest.raises(ValueError, match="missing stamp"):
        B.require_stamp(spark, root, "set")
    with pytest.raises(ValueError, match="case_id_overlap"):
        B.stamp(spark, version, events(2))
    B.stamp(spark, version, events(0))
    assert B.require_stamp(spark, root, "set") == version
    name = B.manifest(spark, version)["files"][0]
    at = f"{version}/{name['part']}/{name['file']}"
    with open(at, "a") as f:
        f.write("\n")
    os.remove(f"{version}/{name['part']}/.{name['file']}.crc")
    with pytest.raises(ValueError, match="changed"):
        B.require_stamp(spark, root, "set")
    B.write_bundle(spark, root, "set", parts(spark, 5))  # a new version has to be validated anew
    with pytest.raises(ValueError, match="missing stamp"):
        B.require_stamp(spark, root, "set")
    assert json.loads(open(f"{version}/{B.STAMP}").read())["passed"]
