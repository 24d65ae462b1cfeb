"""The whole environment: seventeen tools with arguments as JSON, all gates, over the line items as calls; and JSON Schema checks of events.

A line item's part number says which tool it calls, its supplier what is wrong with the call: every tenth has bad arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.json_schema import first_error
from palimpsest.operators import environment as E
from palimpsest.operators import tools as T
from palimpsest.plans.projection import KEYS, SQL, World
from palimpsest.plans.registry import query

CALLED = [*T.ARGUMENTS, "alter_evidence", "no_such_tool", "finalize_case"]
#: How each argument is written, as an expression that Spark and the oracle share; step, part, supp, amount, cited and the case's columns are known.
VALUES = {
    "domain": "CASE WHEN step % 5 = 0 THEN 'nowhere' ELSE realm END", "occurred_at": "CASE WHEN supp % 4 = 0 THEN '2000-01-01' ELSE day END", "policy_id": "split_part(cited, '@', 1)",
    "version": "split_part(cited, '@', 2)", "query": "CASE WHEN supp % 6 = 0 THEN ' ' ELSE 'seal log' END", "case_id": "CAST(case_id AS VARCHAR(20))",
    "evidence_type": "CASE WHEN supp % 2 = 0 THEN 'log' ELSE 'photo' END", "clause_id": "concat('C', step % 4)", "reason": "CASE WHEN supp % 3 = 0 THEN 'no reason' ELSE concat('because of ', cited, ', and so on') END",
    "resolution": """CASE supp % 6 WHEN 0 THEN expected WHEN 1 THEN concat('cite:', cited) WHEN 2 THEN concat('cite:', cited, ' | ', expected) WHEN 3 THEN 'cite:POLX|release' WHEN 4 THEN concat('apply_active_policy per ', cited) ELSE 'refuse' END""",
}
FIELDS = "CASE WHEN supp % 5 = 0 THEN '[]' WHEN supp % 5 = 1 THEN '[\"certificate\",7]' ELSE '[\"certificate\"]' END"


def arguments(tool: str) -> str:
    """An expression for the JSON of a tool's arguments."""
    text = lambda name: FIELDS if name == "fields" else f"concat('\"', {VALUES[name]}, '\"')"
    parts = ", ',', ".join(f"'\"{name}\":', {text(name)}" for name in T.ARGUMENTS[tool])
    return f"concat('{{', {parts}, CASE WHEN supp % 10 = 7 AND part % 3 = 1 THEN ',\"more\":1' ELSE '' END, '}}')"


JSON = "CASE WHEN supp % 10 = 7 AND part % 3 = 0 THEN '{}' WHEN supp % 10 = 7 AND part % 3 = 2 THEN '{\"case_id\":5}' " + " ".join(f"WHEN tool = '{t}' THEN {arguments(t)}" for t in T.ARGUMENTS) + " ELSE '{}' END"
FACTS = {
    "heldout": "CASE case_id % 3 WHEN 0 THEN 'heldout_validate_seal' WHEN 1 THEN 'heldout_redaction_scan' END", "qc_failed": "case_id % 10 = 4", "damaged": "amount > 90000",
    "lacks_materials": "customer % 7 = 0", "lacks_heldout": "customer % 3 = 1", "bar": "case_id % 6",
}


def calls(w: World) -> DataFrame:
    names = F.array(*map(F.lit, CALLED))
    rows = w.steps.withColumns({"tool": F.element_at(names, (F.col("part") % len(CALLED) + 1).cast("int")), "realm": F.expr("CASE domain WHEN 'd0' THEN 'materials' WHEN 'd1' THEN 'laboratory' ELSE 'ai_governance' END"), "day": F.date_format("occurred_at", "yyyy-MM-dd")})
    rows = rows.withColumns({k: F.expr(v) for k, v in FACTS.items()}).withColumn("arguments", F.expr(JSON))
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    given = F.array_compact(F.array(F.when(~F.col("lacks_materials"), "materials_action"), F.lit("laboratory_action"), F.lit("ai_governance_action"), F.when(~F.col("lacks_heldout"), "heldout_tool")))
    return T.checked(rows.withColumns({
        "granted": given, "domain": F.col("realm"), "occurred_at": F.col("day"), "active": F.col("policy_key"), "missing": F.when(F.col("lacks_evidence"), texts("certificate")).otherwise(texts()),
        "prohibited": F.when(F.col("bar") == 0, texts("release_item")).when(F.col("bar") == 1, texts("quarantine_item", "approve_equipment_access")).otherwise(texts()),
        "evidence": F.when(F.col("has_evidence"), texts("log", "seal")).otherwise(texts()), "clauses": texts("C1", "C2"),
    }), KEYS)


listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
WHEN = lambda pairs: " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs)
CALLS = f"""r0 AS (SELECT s.case_id, s.n, s.step, s.part, s.supp, s.amount, s.cited, [{listed(CALLED)}][s.part % {len(CALLED)} + 1] AS tool, c.customer, c.expected, c.policy_key AS active, c.policy_id, c.lacks_evidence, c.has_evidence,
  CASE c.domain WHEN 'd0' THEN 'materials' WHEN 'd1' THEN 'laboratory' ELSE 'ai_governance' END AS realm, strftime(c.occurred_at, '%Y-%m-%d') AS day FROM steps s JOIN cases c USING (case_id)),
r1 AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in FACTS.items())}, {JSON} AS args FROM r0),
r2 AS (SELECT *, list_sort(json_keys(args)) AS keys, CASE tool {WHEN((t, "[" + listed(sorted(a)) + "]") for t, a in T.ARGUMENTS.items())} END AS wanted, CASE tool {WHEN((t, f"'{p}'") for t, p in T.PERMISSIONS.items())} END AS needs,
  CASE tool {WHEN((t, f"'{d}'") for t, d in T.DOMAINS.items())} END AS acts_in, json_extract_string(args, '$.reason') AS reason, trim(json_extract_string(args, '$.resolution')) AS resolution,
  json_extract_string(args, '$.policy_id') || '@' || json_extract_string(args, '$.version') AS named FROM r1),
r3 AS (SELECT *, keys = wanted AND len(list_filter(keys, lambda k: json_type(args, '$.' || k) <> CASE k WHEN 'fields' THEN 'ARRAY' ELSE 'VARCHAR' END)) = 0 AND coalesce(NOT contains(json_extract(args, '$.fields')::VARCHAR, '7'), true) AS valid,
  CASE WHEN resolution LIKE 'cite:%' THEN trim(string_split(trim(substr(resolution, 6)), '|')[1]) END AS cite, CASE WHEN resolution NOT LIKE 'cite:%' THEN resolution WHEN contains(resolution, '|') THEN trim(string_split(resolution, '|')[2]) ELSE 'apply_active_policy' END AS base,
  NULLIF(regexp_extract(reason, 'POL-[A-Z0-9-]+@[0-9]+[.][0-9]+'), '') AS said, NULLIF(regexp_extract(resolution, 'POL-[A-Z0-9-]+@[0-9]+[.][0-9]+'), '') AS told FROM r2),
r4 AS (SELECT *, CASE WHEN active IS NULL THEN 'no_active_policy' WHEN (bar = 0 AND tool = 'release_item') OR (bar = 1 AND tool IN ('quarantine_item', 'approve_equipment_access')) THEN 'prohibited_by_policy' END AS barred,
  CASE WHEN said NOT IN ({listed(KEYS)}) THEN 'hallucinated_policy' WHEN said <> active THEN 'expired_policy_action' END AS cites FROM r3),
c AS (SELECT case_id, n, tool,
  CASE WHEN tool IN ({listed(T.ALTERING)}) THEN 'immutable_evidence' WHEN wanted IS NULL THEN 'unknown_tool' WHEN NOT valid THEN 'invalid_arguments'
    WHEN (needs = 'materials_action' AND lacks_materials) OR (needs = 'heldout_tool' AND lacks_heldout) THEN 'permission_denied' WHEN tool LIKE 'heldout%' AND heldout IS DISTINCT FROM tool THEN 'heldout_tool_not_granted' END AS gate,
  CASE WHEN acts_in <> realm THEN 'wrong_domain' WHEN acts_in = 'materials' AND lacks_materials THEN 'permission_denied' END AS domain_error,
  CASE tool WHEN 'list_available_policies' THEN CASE WHEN json_extract_string(args, '$.domain') = 'nowhere' THEN 'unknown_domain' END
    WHEN 'retrieve_policy' THEN CASE WHEN named NOT IN ({listed(KEYS)}) THEN 'unknown_policy' END WHEN 'check_policy_effective_date' THEN CASE WHEN named NOT IN ({listed(KEYS)}) THEN 'unknown_policy' END
    WHEN 'search_policy_clauses' THEN CASE WHEN trim(json_extract_string(args, '$.query')) = '' THEN 'empty_query' END
    WHEN 'inspect_evidence' THEN CASE WHEN NOT has_evidence OR json_extract_string(args, '$.evidence_type') <> 'log' THEN 'unknown_evidence_type' END
    WHEN 'validate_required_fields' THEN CASE WHEN active IS NULL THEN 'no_active_policy' WHEN json_extract_string(args, '$.clause_id') NOT IN ('C1', 'C2') THEN 'unknown_clause' END
    WHEN 'quarantine_item' THEN barred
    WHEN 'release_item' THEN coalesce(barred, CASE WHEN lacks_evidence THEN 'missing_evidence' WHEN damaged THEN 'prohibited_by_policy' END, cites)
    WHEN 'approve_equipment_access' THEN coalesce(barred, CASE WHEN qc_failed THEN 'prohibited_by_policy' WHEN lacks_evidence THEN 'missing_evidence' END, cites)
    WHEN 'request_missing_evidence' THEN CASE WHEN json_array_length(args, '$.fields') = 0 THEN 'empty_fields' END
    WHEN 'finalize_case' THEN coalesce(CASE WHEN cite NOT LIKE '%@%' OR cite NOT IN ({listed(KEYS)}) THEN 'unsupported_resolution' WHEN cite <> active THEN 'expired_policy_action' END,
      CASE WHEN told NOT IN ({listed(KEYS)}) THEN 'unsupported_resolution' WHEN told <> active THEN 'expired_policy_action' END, CASE WHEN base NOT IN ({listed(T.RESOLUTIONS)}) THEN 'unsupported_resolution' END) END AS late_error,
  CASE tool {WHEN((t, f"'{e}'") for t, e in T.EFFECTS.items())} END AS effect,
  CASE WHEN string_split(named, '@')[1] = policy_id AND (tool = 'retrieve_policy' OR (tool = 'check_policy_effective_date' AND json_extract_string(args, '$.occurred_at') = day)) THEN named <> active END AS selects_stale,
  tool IN ({listed([*T.EFFECTS, "heldout_validate_seal", "heldout_redaction_scan"])}) AS mutates, tool IN ({listed(T.EFFECTS)}) AS rests, tool = 'finalize_case' AS finalizes FROM r4)"""
FOLD = f"""{SQL.replace("WITH versions", "WITH RECURSIVE versions", 1)}, {CALLS},
f AS (SELECT case_id, 0::BIGINT AS n, NULL::VARCHAR AS tool, NULL::VARCHAR AS code, 'open' AS status, false AS finalized, false AS stale FROM (SELECT DISTINCT case_id FROM c)
  UNION ALL SELECT case_id, n, tool, code, CASE WHEN code = 'ok' THEN coalesce(effect, status) ELSE status END, finalized OR (code = 'ok' AND finalizes), CASE WHEN code = 'ok' THEN coalesce(selects_stale, stale) ELSE stale END
  FROM (SELECT c.*, f.status, f.finalized, f.stale, coalesce(c.gate, CASE WHEN mutates AND f.finalized THEN CASE WHEN finalizes THEN 'already_finalized' ELSE 'case_finalized' END END, domain_error,
    CASE WHEN rests AND f.stale THEN 'expired_policy_action' END, late_error, 'ok') AS code FROM f JOIN c ON c.case_id = f.case_id AND c.n = f.n + 1))"""
folded = lambda w: E.fold(calls(w), "case_id", "step", "part", "supp", "amount")
query("env09_all_tools", f"{FOLD} SELECT case_id, n, tool, code, status, finalized FROM f WHERE n > 0", world=False)(folded)
query("env10_codes_of_tools", f"{FOLD} SELECT tool, code, status, count(*) AS n FROM f WHERE n > 0 GROUP BY ALL", world=False)(lambda w: folded(w).groupBy("tool", "code", "status").agg(F.count(F.lit(1)).alias("n")))

# Event properties by three schemas; some get another field, a text for the number, or a list.
PROPS = "CASE event_id % 7 WHEN 1 THEN replace(props, '}', ', \"tags\": [\"a\", 5]}') WHEN 2 THEN replace(props, ': ', ': \"x') WHEN 3 THEN replace(replace(props, ': ', ': \"'), '}', '\"}') WHEN 4 THEN '{}' WHEN 5 THEN replace(props, '}', ', \"more\": null}') ELSE props END"
SHAPES = {
    "strict": {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10}}, "required": ["k"], "additionalProperties": False},
    "tagged": {"type": "object", "properties": {"k": {"type": ["integer", "string"]}, "tags": {"type": "array", "items": {"type": "string"}}}},
    "texts": {"required": ["k"], "additionalProperties": {"type": "string", "minLength": 2}},
}
query("jsn02b_schema_errors", f"""WITH e AS (SELECT event_id, p, CASE WHEN json_valid(p) THEN p::JSON END AS j FROM (SELECT event_id, {PROPS} AS p FROM events)),
k AS (SELECT *, json_type(j, '$.k') AS t, json_extract_string(j, '$.k') AS v, json_keys(j) AS keys FROM e)
SELECT event_id, CASE WHEN j IS NULL THEN '$: not JSON' WHEN t IS NULL THEN '$: k is missing' WHEN list_contains(keys, 'more') THEN '$: more is unknown' WHEN list_contains(keys, 'tags') THEN '$: tags is unknown' WHEN t NOT IN ('UBIGINT', 'BIGINT') THEN '$.k: not of type integer' WHEN v::INT < 10 THEN '$.k: too small' END AS strict,
  CASE WHEN j IS NULL THEN '$: not JSON' WHEN list_contains(keys, 'tags') THEN '$.tags[1]: not of type string' END AS tagged,
  CASE WHEN j IS NULL THEN '$: not JSON' WHEN t IS NULL THEN '$: k is missing' WHEN t <> 'VARCHAR' THEN '$.k: not of type string' WHEN length(v) < 2 THEN '$.k: too short' END AS texts FROM k""", world=False)(
    lambda w: w.table("events").select("event_id", F.expr(PROPS).alias("p")).select("event_id", *(first_error(s, F.col("p")).alias(n) for n, s in SHAPES.items())))
