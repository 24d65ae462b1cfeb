"""Agent traces, case plans, containment, checksums and data set rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.canonical import canonical
from palimpsest.operators import datasets as D
from palimpsest.operators import keyword_search
from palimpsest.operators import temporal as T
from palimpsest.operators import verify as V
from palimpsest.operators.containment import contained
from palimpsest.plans.catalog_domain import TERMS, total
from palimpsest.plans.projection import World
from palimpsest.plans.registry import query

query("jon10_text_containment", """SELECT item_id, b.text <> '' AND EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS contained FROM benchmark b""", world=False)(
    lambda w: contained(w.table("benchmark"), "item_id", w.table("documents")))
def nested(w: World) -> DataFrame:
    """A document for each conversation: its turns in order, and sizes by turn."""
    size = F.length("text")
    rows = w.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", size.alias("size")))).alias("a"))
    turns = F.transform("a", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["size"] / 1e6).alias("share")))
    sizes = F.map_from_entries(F.transform("a", lambda t: F.struct(t["turn"].cast("string"), F.array(t["size"].cast("double"), t["size"] / 8))))
    return rows.select("conv_id", F.struct(turns.alias("turns"), "conv_id", sizes.alias("sizes")).alias("doc"))


# Conversations as nested documents. The oracle writes each text's characters beyond ASCII as UTF-16 units.
ASCII = lambda c: rf"""list_aggregate(list_transform(string_split(to_json({c})::VARCHAR, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN format('\u{{:04x}}', unicode(c))
  ELSE format('\u{{:04x}}\u{{:04x}}', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END), 'string_agg', '')"""  # noqa: E731
query("hsh02b_nested_json", f"""SELECT conv_id, sha256('{{"conv_id":' || conv_id || ',"sizes":{{' || string_agg('"' || turn || '":[' || length(text)::DOUBLE || ',' || length(text) / 8 || ']', ',' ORDER BY turn::VARCHAR) || '}},"turns":[' || string_agg('{{"role":' || {ASCII("role")} || ',"share":' || length(text) / 1e6 || ',"text":' || {ASCII("text")} || '}}', ',' ORDER BY turn) || ']}}') AS sha
  FROM conversations GROUP BY conv_id""", world=False)(lambda w: nested(w).select("conv_id", F.sha2(canonical(F.col("doc"), nested(w).schema["doc"].dataType), 256).alias("sha")))
# Each benchmark text as a query of words.
query("srt02b_keyword_search", r"""WITH d AS (SELECT doc_id, lower(concat_ws(' ', text, source)) AS hay FROM documents), q AS (SELECT item_id AS q, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS words FROM benchmark),
s AS (SELECT q, doc_id, len(list_filter(words, lambda w: contains(hay, w))) AS hits, len(words) AS n FROM q, d), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hits DESC, doc_id) AS rank FROM s)
SELECT q, doc_id, hits / n AS score, rank FROM r WHERE rank <= 10 AND hits > 0""", world=False)(
    lambda w: keyword_search.search(w.table("benchmark"), "item_id", "text", keyword_search.build(w.table("documents"), "doc_id", "text", "source")))
query("hsh02_canonical_json", """SELECT case_id, sha256('{"case_id":' || case_id || ',"domain":"' || domain || '","expected":"' || expected || '"}') AS sha FROM cases""")(
    lambda w: w.orders.select("case_id", F.sha2(D.canonical_json("expected", "case_id", "domain"), 256).alias("sha")))
query("vec04_byte_bag", """WITH h AS (SELECT item_id, hex(text) AS h FROM benchmark), b AS (SELECT item_id, i % 16 AS slot, sum(('0x' || substr(h, (2 * i + 1)::INT, 2))::INT / 255.0::DOUBLE) AS x FROM h, range(256) r(i) WHERE i < length(h) // 2 GROUP BY 1, 2)
  SELECT item_id, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 4) AS x FROM b""", world=False)(
    lambda w: w.table("benchmark").select("item_id", F.posexplode(D.byte_bag(F.col("text"))).alias("slot", "x")).select("item_id", F.col("slot").cast("long").alias("slot"), F.round("x", 4).alias("x")))
query("vec04_byte_bag_decay", """WITH h AS (SELECT item_id, hex(text) AS h FROM benchmark), b AS (SELECT item_id, i % 32 AS slot, sum(('0x' || substr(h, (2 * i + 1)::INT, 2))::INT / 255.0::DOUBLE / (1 + i // 32)) AS x FROM h, range(512) r(i) WHERE i < length(h) // 2 GROUP BY 1, 2)
  SELECT item_id, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 4) AS x FROM b""", world=False)(
    lambda w: w.table("benchmark").select("item_id", F.posexplode(D.byte_bag(F.col("text"), 32, 512, decay=True)).alias("slot", "x")).select("item_id", F.col("slot").cast("long").alias("slot"), F.round("x", 4).alias("x")))
query("dat01_iso_parse", "SELECT case_id, epoch_us(occurred_at) // 1000000 - CASE case_id % 3 WHEN 1 THEN 7200 WHEN 2 THEN -19800 ELSE 0 END AS seconds FROM cases")(
    lambda w: w.orders.select("case_id", F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(*map(F.lit, ("", "+02:00", "-05:30"))), (F.col("case_id") % 3).cast("int") + 1)).alias("text"))
    .select("case_id", F.unix_seconds(X.iso_instant(F.col("text"))).alias("seconds")))
query("str08_completion", """SELECT case_id, '{"resolution": "' || expected || '", "cites": "' || policy_key || '"}' AS completion FROM cases""")(
    lambda w: w.cases.select("case_id", F.format_string('{"resolution": "%s", "cites": "%s"}', "expected", "policy_key").alias("completion")))
query("jsn01_key_order", """SELECT case_id, '{"policy":"' || policy_key || '","resolution":"' || expected || '"}' AS json FROM cases""")(
    lambda w: w.cases.select("case_id", F.from_json(F.to_json(F.struct(F.col("expected").alias("resolution"), F.col("policy_key").alias("policy"))), "resolution string, policy string").alias("j")).select("case_id", F.to_json(F.struct("j.policy", "j.resolution")).alias("json")))

# Agents: the oracle cites the policy in force; the baseline the first of its domain's catalogue, and inspects nothing.
ACT = {"release": "release_item", "quarantine": "quarantine_item", "request_evidence": "request_missing_evidence"}
SQL_ACT = "CASE expected " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACT.items()) + " END"
trace = lambda cited, careful: f"""SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY k) AS n, tool, cited FROM (SELECT case_id, {cited} AS cited, unnest([1, 2, 3, 4]) AS k,
  unnest(['retrieve_policy', CASE WHEN {careful} THEN 'inspect_evidence' END, {SQL_ACT}, 'finalize_case']) AS tool FROM cases) WHERE tool IS NOT NULL"""  # noqa: E731
CALM = "difficulty NOT IN ('1-URGENT', '2-HIGH')"
query("agt02_oracle_trace", trace("policy_key", CALM))(lambda w: D.agent_trace(w.cases, F.col("policy_key"), ACT, F.expr(CALM)))
query("agt01_rag_trace", trace("policy_key", "expected <> 'release'"))(lambda w: D.agent_trace(w.cases, F.col("policy_key"), ACT, F.col("expected") != "release"))
query("agt01_baseline_trace", trace("policy_id || '@1.0'", "false"))(lambda w: D.agent_trace(w.cases, F.concat("policy_id", F.lit("@1.0")), ACT, F.lit(False)))

# Case plans: the templates are those of the cases; urgent ones stand at a boundary.
HASH = "('0x' || substr(sha256('42:{}:' || template || ':' || version), 1, 8))::BIGINT"
PLAN = f"""plan AS (SELECT domain, template, version AS planned, CASE WHEN template LIKE '%URGENT' AND version <> '1.0' THEN effective_at + to_hours([-6, 6, 12][{HASH.format("snap")} % 3 + 1])
  ELSE effective_at + to_days(({HASH.format("day")} % greatest(1, date_diff('day', effective_at, coalesce(expires_at, effective_at + INTERVAL 730 DAYS))))::INT) + to_hours({HASH.format("hour")} % 24) END AS occurred_at
  FROM (SELECT DISTINCT domain, template FROM cases0), versions)"""
templates = lambda w: w.orders.select("domain", "template").distinct().withColumn("boundary", F.col("template").endswith("URGENT"))
planned = lambda w: T.resolve_active(D.case_plan(templates(w), w.policies), w.policies, few=True)
query("dst01_case_plan", f""", {PLAN} SELECT a.template, a.planned, strftime(a.occurred_at, '%Y-%m-%d %H') AS occurred, p.policy_key FROM plan a LEFT JOIN policies p ON p.domain = a.domain AND p.effective_at <= a.occurred_at AND (p.expires_at IS NULL OR a.occurred_at < p.expires_at)""")(
    lambda w: planned(w).select("template", "planned", F.date_format("occurred_at", "yyyy-MM-dd HH").alias("occurred"), "policy_key"))
query("dst02_rendered_cases", f""", {PLAN} SELECT template, planned, 'Case of ' || template || ' on ' || strftime(occurred_at, '%Y-%m-%d') || ' in domain ' || domain || '.' AS text FROM plan""")(
    lambda w: D.case_plan(templates(w), w.policies).select("template", "planned", F.format_string("Case of %s on %s in domain %s.", "template", F.date_format("occurred_at", "yyyy-MM-dd"), "domain").alias("text")))

# Data set rows, stamps and provenance
query("dst06_dpo_rows", f"""SELECT case_id, kind, 'Case ' || case_id || ' in ' || domain AS prompt, expected AS chosen, CASE kind WHEN 'stale' THEN 'stale_' || expected WHEN 'unsupported' THEN 'unsupported' ELSE 'release_item' END AS rejected, {total(list(TERMS))} AS chosen_reward
  FROM checked, (VALUES ('stale'), ('unsupported'), ('unsafe')) t(kind) WHERE success""")(
    lambda w: w.runs.where("success").select("case_id", "domain", "expected", F.round(V.reward(), 6).alias("chosen_reward"), F.explode(F.array(*map(F.lit, ("stale", "unsupported", "unsafe")))).alias("kind"))
    .select("case_id", "kind", F.concat(F.lit("Case "), "case_id", F.lit(" in "), "domain").alias("prompt"), F.col("expected").alias("chosen"), F.when(F.col("kind") == "stale", F.concat(F.lit("stale_"), "expected")).when(F.col("kind") == "unsupported", "unsupported").otherwise("release_item").alias("rejected"), "chosen_reward"))
STAMP = "SELECT split, count(*) AS n_rows, sum(('0x' || substr(sha256(concat_ws('|', case_id, policy_key, expected)), 1, 8))::BIGINT)::VARCHAR AS checksum FROM cases GROUP BY 1"
stamps = lambda w: D.stamp(w.cases, "split", "case_id", "policy_key", "expected")
query("dst11_stamps", STAMP)(stamps)
query("dst15_provenance", f"""SELECT s.split, n_rows, checksum, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM ({STAMP}) s JOIN cases c USING (split) GROUP BY 1, 2, 3""")(
    lambda w: stamps(w).join(w.cases.groupBy("split").agg(F.concat_ws(",", F.array_sort(F.collect_set("version"))).alias("versions")), "split"))
