"""The environment, decisions by rule, evidence views, files in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import environment as E
from palimpsest.operators.frames import stored
from palimpsest.plans.projection import KEYS, SQL, TOOLS, World
from palimpsest.plans.registry import query
from palimpsest.sources import files as S
from palimpsest.streaming.calls import fold_stream

# Domain d0 stands for materials, d1 for the laboratory, d2 for AI governance. Calls of customers divisible by 7 lack the permission
# to escalate; an amount over 90000 stands for damaged packaging.
MUTATING = ["release_item", "quarantine_item", "request_missing_evidence", "create_human_review", "finalize_case"]
EFFECTS = {"release_item": "released", "quarantine_item": "quarantined", "request_missing_evidence": "awaiting_evidence", "create_human_review": "human_review", "finalize_case": "finalized"}


def calls(w: World) -> DataFrame:
    tool, known, current = F.col("tool"), F.col("cited").isin(KEYS), F.col("cited") == F.col("policy_key")
    gate = F.when(~tool.isin(TOOLS), "unknown_tool").when(F.col("failed"), "invalid_arguments").when((tool == "create_human_review") & (F.col("customer") % 7 == 0), "permission_denied")
    late = (
        F.when((tool == "retrieve_policy") & ~known, "unknown_policy").when((tool == "inspect_evidence") & ~F.col("has_evidence"), "unknown_evidence_type")
        .when((tool == "release_item") & (F.col("expected") == "request_evidence"), "prohibited_by_policy").when((tool == "release_item") & (F.col("amount") > 90000), "prohibited_by_policy")
        .when((tool == "release_item") & ~known, "hallucinated_policy").when((tool == "finalize_case") & ~known, "unsupported_resolution").when(tool.isin("release_item", "finalize_case") & ~current, "expired_policy_action")
    )
    return w.steps.withColumns({
        "gate": gate, "domain_error": F.when(tool.isin("release_item", "quarantine_item") & (F.col("domain") != "d0"), "wrong_domain"), "late_error": late, "effect": F.coalesce(*[F.when(tool == k, v) for k, v in EFFECTS.items()]),
        "selects_stale": F.when(tool == "retrieve_policy", ~current), "mutates": tool.isin(MUTATING), "rests": tool.isin(MUTATING), "finalizes": tool == "finalize_case",
    })


CALLS = """c AS (SELECT s.case_id, s.n, s.tool,
  CASE WHEN s.tool = 'ask_oracle' THEN 'unknown_tool' WHEN s.failed THEN 'invalid_arguments' WHEN s.tool = 'create_human_review' AND k.customer % 7 = 0 THEN 'permission_denied' END AS gate,
  CASE WHEN s.tool IN ('release_item', 'quarantine_item') AND k.domain <> 'd0' THEN 'wrong_domain' END AS domain_error,
  CASE WHEN s.tool = 'retrieve_policy' AND s.cited LIKE '%@9.9' THEN 'unknown_policy' WHEN s.tool = 'inspect_evidence' AND NOT k.has_evidence THEN 'unknown_evidence_type'
    WHEN s.tool = 'release_item' AND (k.expected = 'request_evidence' OR s.amount > 90000) THEN 'prohibited_by_policy' WHEN s.tool = 'release_item' AND s.cited LIKE '%@9.9' THEN 'hallucinated_policy'
    WHEN s.tool = 'finalize_case' AND s.cited LIKE '%@9.9' THEN 'unsupported_resolution' WHEN s.tool IN ('release_item', 'finalize_case') AND s.cited <> k.policy_key THEN 'expired_policy_action' END AS late_error,
  CASE s.tool WHEN 'release_item' THEN 'released' WHEN 'quarantine_item' THEN 'quarantined' WHEN 'request_missing_evidence' THEN 'awaiting_evidence' WHEN 'create_human_review' THEN 'human_review' WHEN 'finalize_case' THEN 'finalized' END AS effect,
  CASE WHEN s.tool = 'retrieve_policy' THEN s.cited <> k.policy_key END AS selects_stale, s.tool NOT IN ('retrieve_policy', 'inspect_evidence', 'ask_oracle') AS mutates, s.tool = 'finalize_case' AS finalizes
  FROM steps s JOIN cases k USING (case_id)),
f AS (SELECT case_id, 0::BIGINT AS n, NULL::VARCHAR AS tool, NULL::VARCHAR AS code, 'open' AS status, false AS finalized, false AS stale FROM (SELECT DISTINCT case_id FROM c)
  UNION ALL SELECT case_id, n, tool, code, CASE WHEN code = 'ok' THEN coalesce(effect, status) ELSE status END, finalized OR (code = 'ok' AND finalizes), CASE WHEN code = 'ok' THEN coalesce(selects_stale, stale) ELSE stale END
  FROM (SELECT c.*, f.status, f.finalized, f.stale, coalesce(c.gate, CASE WHEN mutates AND f.finalized THEN CASE WHEN finalizes THEN 'already_finalized' ELSE 'case_finalized' END END, domain_error,
    CASE WHEN mutates AND f.stale THEN 'expired_policy_action' END, late_error, 'ok') AS code FROM f JOIN c ON c.case_id = f.case_id AND c.n = f.n + 1))"""
FOLD = SQL.replace("WITH versions", "WITH RECURSIVE versions", 1) + ", " + CALLS
query("env06_call_fold", f"{FOLD} SELECT case_id, n, tool, code, status, finalized FROM f WHERE n > 0", world=False)(lambda w: E.fold(calls(w), "case_id", "step", "part", "supp", "amount"))
query("env07_call_codes", f"{FOLD} SELECT tool, code, count(*) AS n FROM f WHERE n > 0 GROUP BY 1, 2", world=False)(lambda w: E.fold(calls(w), "case_id", "step", "part", "supp", "amount").groupBy("tool", "code").agg(F.count(F.lit(1)).alias("n")))
def streamed(w: World) -> DataFrame:
    """The same fold by a stream: calls come in three files of later and later steps, every fifth one a file late, and a last file moves the watermark on."""
    rows = calls(w).select("case_id", "step", "part", "supp", "amount", "tool", *E.CALL).withColumn("at", F.expr("timestamp'2020-01-01 00:00:00' + make_dt_interval(0, step)"))
    batch = F.least(F.ceil(F.col("step") / 3) + F.when(F.col("part") % 5 == 0, 1).otherwise(0), F.lit(3))
    at = place(w, "calls")
    rows = stored(rows.withColumn("batch", batch), "calls")
    for n in range(1, 4):
        rows.where(F.col("batch") == n).drop("batch").write.parquet(f"{at}/in/{n}")
    rows.limit(1).drop("batch").withColumns({"case_id": F.lit(-1).cast("long"), "at": F.expr("timestamp'2021-01-01'")}).coalesce(1).write.parquet(f"{at}/in/4")
    name, needed = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = w.spark.conf.get(name)
    w.spark.conf.set(name, needed)
    try:
        for n in range(1, 5):  # each start goes on from the checkpoint of the one before
            stream = w.spark.readStream.schema(rows.drop("batch").schema).parquet(f"{at}/in/[1-{n}]")
            out = fold_stream(stream, "case_id", "at", ["step", "part", "supp", "amount"], "4 hours").writeStream.format("parquet").option("path", f"{at}/out")
            out.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        w.spark.conf.set(name, before)
    return w.spark.read.schema("case_id long, n long, tool string, code string, status string, finalized boolean").parquet(f"{at}/out").where("case_id >= 0")


query("env08_stream_fold", f"{FOLD} SELECT case_id, n, tool, code, status, finalized FROM f WHERE n > 0", world=False)(streamed)
query("env05_required_fields", """SELECT case_id, array_to_string(list_filter(f, lambda x: t[x]), ',') AS present, array_to_string(list_filter(f, lambda x: NOT t[x]), ',') AS missing FROM (SELECT case_id, ['certificate', 'log', 'seal'] AS f,
  map {'certificate': NOT lacks_evidence AND has_evidence, 'log': has_evidence AND case_id % 4 <> 0, 'seal': difficulty NOT IN ('1-URGENT', '2-HIGH')} AS t FROM cases)""")(
    lambda w: (lambda parts: w.cases.select("case_id", F.concat_ws(",", parts[0]).alias("present"), F.concat_ws(",", parts[1]).alias("missing")))(E.required_fields(
        F.array(*map(F.lit, ("certificate", "log", "seal"))), F.when(F.col("lacks_evidence"), F.array(F.lit("certificate"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("has_evidence"), F.create_map(F.lit("certificate"), F.lit(True), F.lit("log"), F.col("case_id") % 4 != 0)).otherwise(F.create_map().cast("map<string,boolean>")),
        F.create_map(F.lit("seal"), F.when(F.col("difficulty").isin("1-URGENT", "2-HIGH"), "").otherwise("intact")))))

# Decisions by rule
FACTS = {k: f"case_id % {m} = 0" for k, m in dict(ignores=41, sensitive=3, external=2, damaged=19, dual=17, stale_document=23, excursion=29, qc_failed=19, after_hours=7, high_impact=13, other_model=31, new_format=43).items()}
facts = lambda: {k: F.expr(v) for k, v in FACTS.items()} | {
    "domain": F.when(F.col("domain") == "d0", "materials").when(F.col("domain") == "d1", "laboratory").otherwise("models"), "key": F.when(F.col("case_id") % 6 != 0, F.col("policy_key")), "lacks": F.col("lacks_evidence"),
    "quantity": F.col("case_id") % 12, "boundary": F.col("boundary"), "level": F.col("case_id") % 5, "least_level": F.when(F.col("case_id") % 11 == 0, 3)}
query("flt14_decide_resolution", f"""SELECT case_id, CASE WHEN ignores AND sensitive AND external THEN 'safe_refusal'
  WHEN domain = 'd0' THEN CASE WHEN damaged THEN 'quarantine' WHEN lacks_evidence THEN 'request_evidence' WHEN case_id % 12 > CASE WHEN v2 THEN 10 ELSE 5 END THEN 'quarantine' WHEN dual THEN 'human_review'
    WHEN boundary OR stale_document THEN CASE WHEN key IS NOT NULL THEN 'reject_stale_and_apply_active' ELSE 'release' END WHEN excursion THEN 'quarantine' ELSE 'release' END
  WHEN domain = 'd1' THEN CASE WHEN qc_failed OR lacks_evidence THEN 'deny' WHEN after_hours THEN CASE WHEN v2 AND case_id % 5 >= 3 THEN 'approve' ELSE 'human_review' END
    WHEN key IS NOT NULL AND NOT v1 AND case_id % 5 < CASE WHEN case_id % 11 = 0 THEN 3 ELSE 2 END THEN 'deny' WHEN boundary AND key IS NOT NULL THEN 'apply_active_policy' ELSE 'approve' END
  ELSE CASE WHEN sensitive AND external THEN 'incident' WHEN high_impact THEN 'human_review' WHEN other_model THEN 'incident' WHEN lacks_evidence AND key IS NOT NULL AND NOT v1 THEN 'human_review'
    WHEN (boundary OR new_format) AND key IS NOT NULL THEN 'apply_active_policy' ELSE 'allow' END END AS decision
  FROM (SELECT *, coalesce(key LIKE '%@2.0', false) AS v2, coalesce(key LIKE '%@1.0', false) AS v1 FROM (SELECT *, CASE WHEN case_id % 6 <> 0 THEN policy_key END AS key, {", ".join(f"{v} AS {k}" for k, v in FACTS.items())} FROM cases))""")(
    lambda w: w.cases.select("case_id", E.decide(facts()).alias("decision")))

# Evidence views: a case's actions as its evidence, in order; those that cite another policy than the one in force are flagged.
KIND = "CASE WHEN cited LIKE '%@9.9' THEN 'policy_excerpt' ELSE tool END"
ITEMS = f", items AS (SELECT s.case_id, s.n, {KIND} AS type, NOT s.failed AS present, s.cited <> c.policy_key AS flagged FROM steps s JOIN cases c USING (case_id))"


def items(w: World) -> DataFrame:
    kind = F.when(F.col("cited").endswith("@9.9"), "policy_excerpt").otherwise(F.col("tool"))
    rows = w.steps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", "part", "supp", "amount", kind.alias("type"), (~F.col("failed")).alias("present"), (F.col("cited") != F.col("policy_key")).alias("flagged")))).alias("a"))
    return rows.select("case_id", F.transform("a", lambda x, i: F.struct(x["flagged"].alias("flagged"), x["type"].alias("type"), (i + 1).alias("place"), x["present"].alias("present"))).alias("items"))


query("srt05_evidence_order", f"{ITEMS} SELECT case_id, coalesce(string_agg(type || ':' || n, ',' ORDER BY k) FILTER (WHERE k <= 2), '') AS inspected FROM (SELECT *, CASE WHEN present THEN row_number() OVER (PARTITION BY case_id, present ORDER BY flagged DESC, type, n) END AS k FROM items) GROUP BY 1")(
    lambda w: items(w).select("case_id", F.concat_ws(",", F.transform(E.evidence_order(F.col("items")), lambda e: F.concat_ws(":", e["type"], e["place"].cast("string")))).alias("inspected")))
query("arr02_evidence_map", f"{ITEMS} SELECT case_id, string_agg(type || '=' || n, ',' ORDER BY type) AS evidence FROM (SELECT case_id, type, max(n) AS n FROM items GROUP BY 1, 2) GROUP BY 1")(
    lambda w: items(w).select("case_id", F.concat_ws(",", F.transform(F.map_entries(E.evidence_map(F.col("items"))), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("evidence")))
query("arr03_update_last", "SELECT case_id, string_agg(CASE WHEN n = m THEN 'stale' ELSE tool END, ',' ORDER BY n) AS tools FROM (SELECT *, max(n) OVER (PARTITION BY case_id) AS m FROM steps) GROUP BY 1")(
    lambda w: w.actions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", "part", "supp", "amount", "tool"))).alias("a")).select("case_id", F.concat_ws(",", F.transform(E.update_last(F.col("a"), lambda x: x.withField("tool", F.lit("stale"))), lambda x: x["tool"])).alias("tools")))
query("arr04_append_step", "SELECT case_id, string_agg(tool, ',' ORDER BY n) || ',finalize_resolution:' || (max(n) + 1) AS tools FROM steps GROUP BY 1")(
    lambda w: w.actions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", "part", "supp", "amount", "tool"))).alias("a")).select("case_id", F.concat_ws(",", F.array_append(F.col("a.tool"), F.concat(F.lit("finalize_resolution:"), F.size("a") + 1))).alias("tools")))


# Files in and out: each query writes to the shared folder, by one sink, and reads that again, by one source.
def place(w: World, name: str) -> str:
    return f"{S.shared_folder(w.spark)}/{name}-{uuid.uuid4().hex}"


def round_trip(name: str, write, read, frame, sql: str, world: bool = True) -> None:  # noqa: ANN001
    def build(w: World) -> DataFrame:
        at = place(w, name)
        write(frame(w), at)
        return read(w.spark, at)

    query(name, sql, world)(build)


nations = lambda w: w.table("nation").select("n_nationkey", "n_name", "n_regionkey")
NATION, NATIONS = "n_nationkey long, n_name string, n_regionkey long", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"
versions = lambda w: w.cases.select("case_id", F.col("version").alias("policy_version"), "split")
VERSIONS, CASE = "SELECT case_id, version AS policy_version, split FROM cases", "case_id long, policy_version string, split string"
round_trip("snk01_src01_json", S.write_json, lambda s, p: S.read_json(s, p, NATION), nations, NATIONS, False)
round_trip("snk02_src04_jsonl", S.write_jsonl, lambda s, p: S.read_jsonl(s, p, CASE), versions, VERSIONS)
round_trip("src05_jsonl_version_filter", S.write_jsonl, lambda s, p: S.read_jsonl(s, p, CASE, versions=["1.0", "1.1"], limit=500, order="case_id"), versions, VERSIONS + " WHERE version IN ('1.0', '1.1') ORDER BY case_id LIMIT 500")
# Every third row has its text in its messages, every other one its version in its metadata.
round_trip("src05b_training_rows", S.write_jsonl, lambda s, p: S.read_training(s, p, ["1.0", "1.1"], 2000), lambda w: w.cases.select(
    "case_id", F.when(F.col("case_id") % 3 != 0, F.concat(F.lit("case "), "case_id")).otherwise("").alias("text"), F.when(F.col("case_id") % 3 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("a question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("expected").alias("content")))).alias("messages"),
    F.when(F.col("case_id") % 2 == 0, F.col("version")).alias("policy_version"), F.struct(F.when(F.col("case_id") % 2 != 0, F.col("version")).alias("policy_version")).alias("metadata")),
    "SELECT case_id, CASE WHEN case_id % 3 <> 0 THEN 'case ' || case_id ELSE expected END AS text, version AS policy_version FROM cases WHERE version IN ('1.0', '1.1') ORDER BY case_id LIMIT 2000")
round_trip("snk03_partitioned", lambda df, p: S.write_jsonl(df, p, ["split"]), lambda s, p: s.read.schema(CASE).json(p).select("case_id", "policy_version", "split"), versions, VERSIONS)
round_trip("snk04_csv", lambda df, p: S.write_csv(df, p, ["n_name", "n_nationkey"]), lambda s, p: s.read.option("header", True).schema("n_name string, n_nationkey long").csv(p), nations, "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation", False)
round_trip("src02_directory", lambda df, p: [S.write_json(df, f"{p}/a"), S.write_json(df.withColumn("n_name", F.upper("n_name")), f"{p}/b")], lambda s, p: S.read_directory(s, p, NATION, ["n_nationkey"]), nations, NATIONS.replace("n_name,", "upper(n_name) AS n_name,"), False)
round_trip("hsh03_src08_file_digests", lambda df, p: [df.coalesce(1).write.text(f"{p}/{x}") for x in ("run1", "run2")], lambda s, p: S.catalogue(s, p).select("folder", "n_files", "n_bytes", "sha256"), lambda w: w.table("supplier").select("s_name").orderBy("s_name"),
           "SELECT folder, 1::BIGINT AS n_files, length(t)::BIGINT AS n_bytes, sha256(t) AS sha256 FROM (SELECT string_agg(s_name || chr(10), '' ORDER BY s_name) AS t FROM supplier), (VALUES ('run1'), ('run2')) v(folder)")
query("snk07_manifest", "SELECT 'nation' AS name, count(*) AS rows FROM nation", world=False)(lambda w: S.manifest(nations(w), "nation").select("name", "rows"))
query("snk09_size_cap", """SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN length(j) > 50 THEN '{"truncated":true,"size":' || length(j) || '}' ELSE j END AS json FROM (SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS j FROM nation)""", world=False)(
    lambda w: nations(w).select("n_nationkey", S.clip(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")), 50).alias("json")))
