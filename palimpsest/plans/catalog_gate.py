"""The clean split, its manifests and the leakage gate.

Training and evaluation sets are made from cases; some rows are made to leak on purpose: cases of the held-out version in the
SFT set, a clause's text in others, and two of the manifests' values are old.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import datasets as D
from palimpsest.operators.frames import new_folder
from palimpsest.plans.projection import World
from palimpsest.plans.registry import query
from palimpsest.sources import bundle as B
from palimpsest.sources import files as S

CLAUSE = "Under {key} every decision of the domain is kept on record for ten years"


def clauses(w: World) -> DataFrame:
    return w.policies.select("version", F.format_string(CLAUSE.format(key="%s"), "policy_key").alias("text"))


def sft(w: World) -> DataFrame:
    text = F.concat(F.lit("Case "), "case_id", F.lit(" cites "), "policy_key", F.lit(": "), "expected", F.when(F.col("case_id") % 89 == 0, F.concat(F.lit(': "'), F.format_string(CLAUSE.format(key="%s"), "policy_key"), F.lit('."'))).otherwise(""))
    rows = w.cases.where("split = 'train' and (version <> '2.0' or case_id % 97 = 0)")
    return rows.select("case_id", F.col("version").alias("policy_version"), "split", *(F.lit(None).cast("string").alias(c) for c in ("prompt", "chosen", "rejected")), text.alias("text"))


def dpo(w: World) -> DataFrame:
    rows = w.cases.where("case_id % 5 = 1 and version <> '2.0'")
    return rows.select("case_id", F.col("version").alias("policy_version"), F.lit("train").alias("split"), F.concat(F.lit("Case "), "case_id").alias("prompt"), F.col("expected").alias("chosen"), F.lit("stale").alias("rejected"), F.lit(None).cast("string").alias("text"))


def held(w: World) -> DataFrame:
    return w.cases.where("version = '2.0' and (split = 'test' or case_id % 97 = 0)").select("case_id", F.col("version").alias("policy_version"), F.lit("test").alias("split"), F.concat(F.lit("Case "), "case_id").alias("prompt"), F.col("expected").alias("expected_resolution"))


def found(sets: DataFrame) -> DataFrame:
    """name, hash (order-free) and path of each set."""
    kept = D.stamp(sets, "name", "case_id", "policy_version")
    return kept.select("name", F.col("checksum").alias("hash"), F.concat(F.lit("data/"), "name").alias("path"))


def recorded(kept: DataFrame) -> DataFrame:
    """What manifests say that were written before two of the sets changed and one was moved."""
    old = lambda name: F.when(F.col("name") == name, "old").otherwise(F.col("hash"))
    return kept.select("name", old("dpo").alias("hash"), F.when(F.col("name") == "sft", "data/elsewhere").otherwise(F.col("path")).alias("path"), old("eval").alias("split_hash"))


def gate(w: World) -> DataFrame:
    sets = D.together(sft(w), dpo(w), held(w))
    kept = D.stored(found(sets), "stamps")
    return D.leakage_events(sets, clauses(w), recorded(kept), kept)


def clean_gate(w: World) -> DataFrame:
    """The gate of sets without what leaks: neither cases of the held-out version nor answers that are evaluated."""
    none = F.lit(None).cast("string")
    told = held(w).where("case_id % 97 <> 0").withColumn("expected_resolution", none).withColumn("prompt", none)
    sets = D.together(sft(w).where("policy_version <> '2.0'"), dpo(w).where("chosen = 'none'"), told)
    kept = D.stored(found(sets), "stamps")
    return D.assert_clean(D.leakage_events(sets, clauses(w), kept.withColumn("split_hash", F.col("hash")), kept))


def changed_stamps(w: World) -> DataFrame:
    sets = D.together(sft(w), dpo(w), held(w))
    stamps = recorded(found(sets)).where("name <> 'eval'").select("name", F.col("hash").alias("checksum"))
    return D.stamp_events(sets.select("name", "case_id", "policy_version"), stamps, "name", "case_id", "policy_version")


SETS = """, clauses AS (SELECT version, 'Under ' || policy_key || ' every decision of the domain is kept on record for ten years' AS text FROM policies),
sft AS (SELECT case_id, version AS policy_version, split, NULL AS prompt, NULL AS chosen, NULL AS rejected, 'Case ' || case_id || ' cites ' || policy_key || ': ' || expected || CASE WHEN case_id % 89 = 0 THEN ': "Under ' || policy_key || ' every decision of the domain is kept on record for ten years."' ELSE '' END AS text
  FROM cases WHERE split = 'train' AND (version <> '2.0' OR case_id % 97 = 0)),
dpo AS (SELECT case_id, version AS policy_version, 'train' AS split, 'Case ' || case_id AS prompt, expected AS chosen, 'stale' AS rejected, NULL AS text FROM cases WHERE case_id % 5 = 1 AND version <> '2.0'),
held AS (SELECT case_id, version AS policy_version, 'test' AS split, 'Case ' || case_id AS prompt, expected AS expected_resolution FROM cases WHERE version = '2.0' AND (split = 'test' OR case_id % 97 = 0)),
train AS (SELECT 'sft' AS side, * FROM sft UNION ALL SELECT 'dpo', * FROM dpo)"""
SUM = "sum(('0x' || substr(sha256(concat_ws('|', case_id, policy_version)), 1, 8))::BIGINT)::VARCHAR"
FOUND = f""", found AS (SELECT 'sft' AS name, {SUM} AS hash, 'data/sft' AS path FROM sft UNION ALL SELECT 'dpo', {SUM}, 'data/dpo' FROM dpo UNION ALL SELECT 'eval', {SUM}, 'data/eval' FROM held),
recorded AS (SELECT name, CASE name WHEN 'dpo' THEN 'old' ELSE hash END AS hash, CASE name WHEN 'sft' THEN 'data/elsewhere' ELSE path END AS path, CASE name WHEN 'eval' THEN 'old' ELSE hash END AS split_hash FROM found),
told AS (SELECT name, r.hash IS DISTINCT FROM f.hash AS changed, r.path IS DISTINCT FROM f.path AS moved, r.split_hash IS DISTINCT FROM f.hash AS split_changed FROM recorded r FULL JOIN found f USING (name))"""
EVENT_SQL = """
SELECT 'sft_forbidden_version' AS event, count(*) AS n FROM sft WHERE policy_version NOT IN ('1.0', '1.1')
UNION ALL SELECT 'dpo_forbidden_version', count(*) FROM dpo WHERE policy_version NOT IN ('1.0', '1.1')
UNION ALL SELECT 'eval_version_mismatch', CASE WHEN count(*) FILTER (WHERE policy_version = '2.0') = 0 THEN 1 ELSE 0 END + count(*) FILTER (WHERE policy_version <> '2.0') FROM held
UNION ALL SELECT 'case_id_overlap', count(*) FROM (SELECT case_id FROM train INTERSECT SELECT case_id FROM held)
UNION ALL SELECT 'cross_split_case_ids', count(*) FROM (SELECT case_id FROM (SELECT case_id, split FROM train UNION ALL SELECT case_id, split FROM held) GROUP BY 1 HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'v2_version_marker_in_train', count(*) FROM train WHERE contains(concat_ws(chr(10), prompt, chosen, rejected, text), '@2.0')
UNION ALL SELECT 'v2_policy_text_in_train', count(*) FROM (SELECT DISTINCT c.text FROM clauses c WHERE version = '2.0' AND EXISTS (SELECT 1 FROM train t WHERE contains(concat_ws(chr(10), prompt, chosen, rejected, t.text), c.text)))
UNION ALL SELECT 'eval_reference_in_train', count(*) FROM (SELECT unnest([prompt, chosen, rejected, text]) AS v FROM train) WHERE v IN (SELECT prompt FROM held UNION SELECT expected_resolution FROM held)
UNION ALL SELECT 'sft_manifest_hash_mismatch', count(*) FROM told WHERE name = 'sft' AND changed UNION ALL SELECT 'dpo_manifest_hash_mismatch', count(*) FROM told WHERE name = 'dpo' AND changed
UNION ALL SELECT 'split_manifest_hash_mismatch', count(*) FROM told WHERE split_changed
UNION ALL SELECT 'sft_manifest_path_mismatch', count(*) FROM told WHERE name = 'sft' AND moved UNION ALL SELECT 'dpo_manifest_path_mismatch', count(*) FROM told WHERE name = 'dpo' AND moved"""
query("dst09_leakage_events", SETS + FOUND + EVENT_SQL)(gate)
query("dst09b_gate_of_clean_sets", f"""{SETS}, t AS (SELECT * FROM sft WHERE policy_version <> '2.0'), e AS (SELECT * FROM held WHERE case_id % 97 <> 0)
SELECT NOT EXISTS (SELECT 1 FROM t WHERE policy_version NOT IN ('1.0', '1.1')) AND NOT EXISTS (SELECT 1 FROM e WHERE policy_version <> '2.0') AND EXISTS (SELECT 1 FROM e)
  AND NOT EXISTS (SELECT 1 FROM t JOIN e USING (case_id)) AND NOT EXISTS (SELECT 1 FROM t WHERE contains(text, '@2.0')) AND NOT EXISTS (SELECT 1 FROM t, clauses c WHERE c.version = '2.0' AND contains(t.text, c.text)) AS passed""")(clean_gate)
query("dst08_clean_split", "SELECT case_id, CASE WHEN version = '2.0' AND split = 'test' THEN 'eval' ELSE 'train' END AS side FROM cases WHERE version = '2.0' AND split = 'test' OR version <> '2.0' AND customer NOT IN (SELECT customer FROM cases WHERE version = '2.0' AND split = 'test')")(
    lambda w: D.clean_split(w.cases))
query("dst08b_clean_split_topped_up", """, ev AS (SELECT * FROM cases WHERE version = '2.0' AND split = 'test'), free AS (SELECT * FROM cases WHERE version <> '2.0' AND customer NOT IN (SELECT customer FROM ev)),
k AS (SELECT case_id, domain, row_number() OVER (PARTITION BY domain ORDER BY case_id) AS k FROM free WHERE split <> 'train'), n AS (SELECT domain, count(*) AS n FROM free WHERE split = 'train' GROUP BY 1)
SELECT case_id, 'eval' AS side FROM ev UNION ALL SELECT case_id, 'train' FROM free WHERE split = 'train' UNION ALL SELECT case_id, 'train' FROM k LEFT JOIN n USING (domain) WHERE k <= 2000 - coalesce(n, 0)""")(lambda w: D.clean_split(w.cases, 2000))
query("dst08c_manifests", f"{SETS}{FOUND} SELECT * FROM found")(lambda w: found(D.together(sft(w), dpo(w), held(w))))
query("dst11b_stamp_events", f"""{SETS}{FOUND}
SELECT f.name, CASE WHEN s.name IS NULL THEN 'missing_stamp' ELSE 'hash_changed' END AS event FROM found f LEFT JOIN (SELECT * FROM recorded WHERE name <> 'eval') s USING (name) WHERE s.hash IS DISTINCT FROM f.hash""")(changed_stamps)


# Bundles of files. Small parts are one sorted file, whose digest the oracle knows; large ones are many.
def bundled(w: World) -> DataFrame:
    one = lambda df, order: df.orderBy(order).coalesce(1)
    customers = w.table("customer")
    parts = {
        "nation": (one(w.table("nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey"), S.write_jsonl),
        "segments": (one(customers.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")), "segment"), lambda df, p: S.write_csv(df, p, ["segment", "n"])),
        "customers": (customers.select("c_custkey", "c_name", "c_mktsegment").repartition(8), S.write_jsonl),
    }
    root = new_folder(w.spark, "bundles")
    B.write_bundle(w.spark, root, "tables", parts)
    files = B.digests(w.spark, B.current(w.spark, root, "tables"))
    return files.groupBy("part").agg(F.sum("n_bytes").alias("n_bytes"), F.when(F.count(F.lit(1)) == 1, F.min("sha256")).alias("sha256"))


def changed_bundle(w: World) -> DataFrame:
    """What is found in a bundle of the sets after one of them was written again in place."""
    root = new_folder(w.spark, "bundles")
    version = B.write_bundle(w.spark, root, "sets", {n: (df, S.write_jsonl) for n, df in (("sft", sft(w)), ("dpo", dpo(w)), ("eval", held(w)))})
    S.write_jsonl(dpo(w).withColumn("chosen", F.lit("other")), f"{version}/dpo")
    return B.changes(w.spark, version).select("part", "event").distinct()


query("snk08_bundle", """WITH t AS (SELECT 'nation' AS part, string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' || chr(10), '' ORDER BY n_nationkey) AS t FROM nation
  UNION ALL SELECT 'segments', 'segment,n' || chr(10) || string_agg(s || ',' || n || chr(10), '' ORDER BY s) FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1))
SELECT part, strlen(t)::BIGINT AS n_bytes, sha256(t) AS sha256 FROM t UNION ALL SELECT 'customers', sum(strlen('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}') + 1)::BIGINT, NULL FROM customer""", world=False)(bundled)
query("dst11c_changed_bundle", f"{SETS} SELECT DISTINCT 'dpo' AS part, event FROM dpo, (VALUES ('missing_file'), ('unknown_file')) e(event)")(changed_bundle)
