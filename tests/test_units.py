"""Boundaries, traps and round trips."""

import json
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.text import iso_instant
from palimpsest.operators import temporal as T
from palimpsest.operators.datasets import canonical_json
from palimpsest.plans.projection import World
from palimpsest.sources import files
from palimpsest.streaming.audit import tumbling


@pytest.mark.parametrize("at,version", [("1994-12-31", None), ("1995-01-01", "1.0"), ("1996-12-31 23:59:59", "1.0"), ("1997-01-01", "1.1"), ("1999-01-01", "2.0"), ("2030-01-01", "2.0")])
def test_windows_are_half_open(spark, sf, at, version):
    case = spark.createDataFrame([(1, "d0", at)], "case_id int, domain string, t string").withColumn("occurred_at", F.col("t").cast("timestamp_ntz"))
    w = World(spark, sf)
    assert [r.version for r in T.resolve_active(case, w.policies).collect()] == [version]
    assert [r.version for r in T.latest_active(case, w.policies).collect()] == [version]


def test_unknown_policy_is_stale(spark, sf):
    w = World(spark, sf)
    bad = T.stale_flags(w.actions, w.cases, w.policies).where("cited like '%9.9'")
    assert bad.count() == bad.where("stale").count() > 0


def test_resolution_matches(spark):
    rows = [("release", "released", True), ("release", "", True), ("deny", "approve", False), ("safe_refusal", "incident", True), ("refuse", "incident", True), (" Release ", "RELEASE", True), ("human_review", "create_human_review now", True)]
    df = spark.createDataFrame(rows, "e string, a string, want boolean")
    assert df.where(X.resolution_matches(F.col("e"), F.col("a")) != F.col("want")).count() == 0


def test_diversity_equals_greedy(spark):
    cases = [(i, f"d{i % 3}", f"d{i % 3}t{(i * 7) % 5}") for i in range(40)]
    rest, seen, want = list(cases), set(), []
    while rest:
        pick = min(rest, key=lambda c: (c[2] in seen, c[1], c[0]))
        rest.remove(pick)
        seen.add(pick[2])
        want.append(pick[0])
    df = spark.createDataFrame(cases, "case_id int, domain string, template string")
    got = df.selectExpr("*", "row_number() over (partition by template order by domain, case_id) k").orderBy(F.col("k") > 1, "domain", "case_id")
    assert [r.case_id for r in got.collect()] == want


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "1.0", "x"), ("b", "2.0", None), ("c", None, "é")], "id string, policy_version string, text string")
    files.write_jsonl(df, f"{tmp_path}/j")
    back = files.read_jsonl(spark, f"{tmp_path}/j", df.schema)
    assert files.manifest(back, "m").first() == files.manifest(df, "m").first()
    assert [r.id for r in files.read_jsonl(spark, f"{tmp_path}/j", df.schema, ["1.0", "1.1"], 5, "id").collect()] == ["a"]
    files.write_jsonl(df, f"{tmp_path}/p", ["policy_version"])
    files.write_csv(df, f"{tmp_path}/c", ["text", "id"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").columns == ["text", "id"]
    (tmp_path / "d/schemas").mkdir(parents=True)
    (tmp_path / "d/1.json").write_text('{"id": "k", "text": "old"}')
    (tmp_path / "d/2.json").write_text('[{"id": "k", "text": "new"}]')
    (tmp_path / "d/schemas/3.json").write_text('{"id": "z"}')
    assert [tuple(r) for r in files.read_directory(spark, f"{tmp_path}/d", "id string, text string", ["id"]).collect()] == [("k", "new")]
    assert files.read_json(spark, f"{tmp_path}/d/2.json", "id string, text string").count() == 1
    assert [len(r.json) < 60 for r in files.clipped(spark.createDataFrame([("x" * 500,)], "t string"), 100).collect()] == [True]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = tumbling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("audit").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("audit").collect())) == sorted(map(tuple, tumbling(events).collect()))


def test_sections_and_stamps(spark):
    from pyspark.sql import functions as F

    from palimpsest.operators import datasets as D

    text = "Case.\nExamples:\na b\nTool schema: x"
    df = spark.createDataFrame([(1, text), (2, "Case.\nExamples:\nc"), (3, "plain "), (4, None)], "id int, t string")
    cut = {r.id: r.t for r in df.select("id", D.drop_section(F.col("t"), r"\nExamples:\s*\n", ["Tool schema:"]).alias("t")).collect()}
    assert cut == {1: "Case.Tool schema: x", 2: "Case.", 3: "plain ", 4: None}
    old = D.stamp(df.where("id < 3"), "id", "t")
    events = D.stamp_events(df.where("id <> 4").withColumn("t", F.when(F.col("id") == 2, "other").otherwise(F.col("t"))), old, "id", "t")
    assert {r.id: r.event for r in events.collect()} == {2: "hash_changed", 3: "missing_stamp"}


def test_containment_cases(spark):
    from palimpsest.operators.containment import contained

    clauses = spark.createDataFrame([(1, "a b c d e f"), (2, "z"), (3, ""), (4, None), (5, "b c"), (6, "a b c d e g")], "id int, text string")
    texts = spark.createDataFrame([("x a b c d e f. y",), ("",), (None,)], "text string")
    got = {r.id: r.contained for r in contained(clauses, "id", texts).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert not any(r.contained for r in contained(clauses, "id", texts.limit(0)).collect())


def test_prompt_truncation_keeps_the_policy(spark):
    from palimpsest.operators import datasets as D

    text = "Case " + "x" * 400 + "\nExamples:\n" + "e" * 100 + "\nPolicy history:\n" + "h" * 100 + "\nCurrent policy: keep\nTool schema: {}"
    df = spark.createDataFrame([(text,)], "t string")
    got = {n: df.select(D.truncate_prompt(F.col("t"), n)).first()[0] for n in (1000, 145, 120, 40)}
    assert got[1000] == text and "Examples" not in got[145] and "history" in got[145]
    assert got[120] == "Case " + "x" * 400 + "\nCurrent policy: keep\nTool schema: {}"
    assert got[40].startswith("Case xx") and got[40].endswith("Current policy: keep\nTool schema: {}") and len(got[40]) // 4 <= 40


def test_turns_as_the_loop():
    import random

    from palimpsest.operators.datasets import turns

    rng = random.Random(7)
    for _ in range(400):
        sizes, most = [rng.randrange(0, rng.choice([3, 8, 30])) for _ in range(rng.randrange(0, 9))], rng.choice([1, 5, 20, 1000])
        names, left, at, want = list(range(len(sizes))), list(sizes), 0, []
        while at < most and names:
            g = names[at % len(names)]
            if left[g]:
                want.append((at + 1, g, sizes[g] - left[g] + 1))
                left[g], at = left[g] - 1, at + 1
            else:
                names = [g for g in names if left[g]]
        got = [(first + i * step, g, before + i + 1) for g, before, visits, first, step in turns(sizes, most) for i in range(visits)]
        assert sorted(got) == want


def test_round_robin_after_exhaustion(spark):
    from palimpsest.operators import datasets as D

    rows = [("a", 1), *(("b", i) for i in (2, 3, 4)), *(("c", i) for i in (5, 6, 7))]
    got = D.round_robin(spark.createDataFrame(rows, "g string, k long"), "g", "k", 7).orderBy("turn").collect()
    at = dict((k, g) for g, k in rows)
    assert [at[r.k] for r in got] == ["a", "b", "c", "c", "b", "c", "b"]


def test_gate_fails_on_leaks(spark):
    from palimpsest.operators import datasets as D

    events = spark.createDataFrame([("case_id_overlap", 2), ("sft_forbidden_version", 0)], "event string, n long")
    with pytest.raises(Exception, match="case_id_overlap"):
        D.assert_clean(events).collect()


def test_yaml_mapping(spark, tmp_path):
    from palimpsest.sources import files as S

    (tmp_path / "a.yaml").write_text("k: 1\nl: [a, b]\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert S.read_yaml(spark, str(tmp_path / "a.yaml")) == {"k": 1, "l": ["a", "b"]}
    with pytest.raises(ValueError):
        S.read_yaml(spark, str(tmp_path / "b.yaml"))


def test_late_events_are_left_out(spark, tmp_path):
    """Spark drops rows behind the watermark that the batch before had, and emits windows once the watermark has passed them."""
    rows = [[("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("a", "2024-01-01 05:00:00", 4.0)], [("a", "2024-01-01 04:30:00", 16.0)], [("a", "2024-01-01 00:20:00", 8.0), ("a", "2024-01-01 09:00:00", 32.0)]]
    schema = "event_type string, ts timestamp, value double"
    for r in rows:
        spark.createDataFrame(r, "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read by their time
    stream = tumbling(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), late="1 hour")
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start.hour, r.n, r.total) for r in spark.table("late").collect()) == [(0, 2, 3.0), (4, 1, 16.0), (5, 1, 4.0)]


def test_canonical_json_as_python(spark):
    texts = ["plain", "", None, 'quo"te\\ and / slash', "tab\tnew\nline\r\b\f", "\x01\x0b\x0e\x1a\x1f \x7f", "\\u001F stays \x1f", "ünïcödé ß 漢字", "😀 pair \u2028", "\\\x1f"]
    got = spark.createDataFrame(list(enumerate(texts)), "b long, a string").select("b", canonical_json("b", "a").alias("j")).collect()
    assert [r.j for r in sorted(got)] == [json.dumps({"a": t, "b": i}, sort_keys=True, separators=(",", ":")) for i, t in enumerate(texts)]


def test_naive_times_are_utc(spark):
    texts = ["2024-03-01T12:00:00", "2024-03-01T12:00:00Z", "2024-03-01T14:00:00+02:00", "2024-03-01T06:30:00-0530", None]
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_seconds(iso_instant(F.col("t")))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r[0] for r in got] == [1709294400] * 4 + [None]


def test_gates_that_fail(spark, tmp_path):
    import pytest

    from palimpsest.operators import datasets as D
    from palimpsest.sources import files as S

    rows = spark.createDataFrame([("1.0",), ("2.0",), (None,)], "v string")
    with pytest.raises(Exception, match="forbidden versions: 2.0, none"):
        D.assert_versions(rows, "v", ["1.0", "1.1"]).collect()
    assert D.assert_versions(rows.where("v = '1.0'"), "v", ["1.0"]).collect()[0].passed
    (tmp_path / "rows.jsonl").write_text('{"case_id":1,"text":"","messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}],"metadata":{"policy_version":"1.1"}}\n\n{"case_id":2,"text":"t","policy_version":"2.0"}\n{"case_id":3}\n')
    got = S.read_training(spark, str(tmp_path)).orderBy("case_id").collect()
    assert [tuple(r) for r in got] == [(1, "b", "1.1"), (2, "t", "2.0"), (3, "", None)]
    with pytest.raises(ValueError, match="no training rows"):
        S.read_training(spark, str(tmp_path), ["9.9"])
    assert S.json_schema(rows) == {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {"v": {"type": ["string", "null"]}}, "required": [], "additionalProperties": False}
