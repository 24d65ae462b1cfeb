"""Temporal, filter, join, set, window and sort queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import datasets as D
from palimpsest.operators import temporal as T
from palimpsest.operators.frames import stored
from palimpsest.plans.registry import query

day = lambda c, alias=None: F.date_format(c, "yyyy-MM-dd").alias(alias or c)
joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_list(c)))
row_n = lambda w: F.row_number().over(w).cast("long")
digest = lambda c: F.unhex(F.sha2(c, 256)).alias("sha")  # equal texts meet by digest, so that no text is shuffled
STEPS = lambda: Window.partitionBy("case_id").orderBy("step", "part", "supp", "amount")


# Temporal
query("jon01_asof_policy", "SELECT case_id, domain, version, policy_key FROM cases")(lambda w: w.cases.select("case_id", "domain", "version", "policy_key"))
query("jon02_stale_flag", "SELECT a.case_id, step, part, cited, a.cited <> c.policy_key AS stale FROM actions a JOIN cases c USING (case_id)")(
    lambda w: T.stale_flags(w.actions, w.cases, w.policies).select("case_id", "step", "part", "cited", "stale"))
query("ver02_stale_citation_rate", """SELECT c.domain, c.version, count(*) AS n, round(avg(CASE WHEN x.stale THEN 1.0 ELSE 0.0 END), 6) AS stale_rate FROM (SELECT a.case_id, bool_or(a.cited <> c.policy_key) AS stale
  FROM actions a JOIN cases c USING (case_id) GROUP BY 1) x JOIN cases c USING (case_id) GROUP BY 1, 2""")(
    lambda w: T.stale_flags(w.actions, w.cases, w.policies).groupBy("case_id", "domain", "version").agg(F.bool_or("stale").alias("stale"))
    .groupBy("domain", "version").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("stale"), 1.0).otherwise(0.0)), 6).alias("stale_rate")))
query("jon03_policy_lookup", "SELECT a.case_id, a.step, a.part, a.cited, strftime(p.effective_at, '%Y-%m-%d') AS effective_at FROM actions a LEFT JOIN policies p ON a.cited = p.policy_key")(
    lambda w: w.actions.join(F.broadcast(w.policies.select("policy_key", "effective_at")), F.col("cited") == F.col("policy_key"), "left").select("case_id", "step", "part", "cited", day("effective_at")))
query("jon15_stale_alternative", """SELECT case_id, coalesce(other, policy_id || '@0.0-stale') AS alternative FROM (SELECT c.case_id, c.policy_id, p.policy_key AS other,
  row_number() OVER (PARTITION BY c.case_id ORDER BY p.effective_at, p.version) AS k FROM cases c LEFT JOIN policies p ON p.domain = c.domain AND p.policy_key <> c.policy_key) WHERE k = 1""")(
    lambda w: T.stale_alternative(w.cases, w.policies).select("case_id", "alternative"))
query("flt01_effective_window", "SELECT c.case_id, p.policy_key, p.effective_at <= c.occurred_at AND (p.expires_at IS NULL OR c.occurred_at < p.expires_at) AS effective FROM cases0 c JOIN policies p USING (domain)")(
    lambda w: w.orders.join(F.broadcast(w.policies), "domain").select("case_id", "policy_key", T.in_force(F.col("occurred_at"), F.col("effective_at"), F.col("expires_at")).alias("effective")))
query("win05_latest_effective", "SELECT case_id, version FROM cases")(lambda w: T.latest_active(w.orders, w.policies).select("case_id", "version"))

# Filters and projections
query("flt04_select_cases", "SELECT case_id, version, split FROM cases WHERE split = 'validation' AND version IN ('1.0', '1.1') ORDER BY case_id LIMIT 200")(
    lambda w: w.cases.where("split = 'validation' and version in ('1.0', '1.1')").orderBy("case_id").limit(200).select("case_id", "version", "split"))
query("flt06_metadata_fallback", "SELECT event_id, coalesce(CASE WHEN event_type = 'view' THEN 'v' || (user_id % 3) END, json_extract_string(props, '$.k')) AS version FROM events", world=False)(
    lambda w: w.table("events").select("event_id", F.coalesce(F.when(F.col("event_type") == "view", F.concat(F.lit("v"), F.col("user_id") % 3)), F.get_json_object("props", "$.k")).alias("version")))
query("flt07_version_filter", "SELECT case_id, version FROM cases WHERE version IN ('1.0', '1.1')")(lambda w: w.cases.where(F.col("version").isin("1.0", "1.1")).select("case_id", "version"))
query("flt08_forbidden_versions", "SELECT case_id, version FROM cases WHERE split = 'train' AND version IN ('2.0') ORDER BY case_id LIMIT 50")(lambda w: w.cases.where("split = 'train'").where(F.col("version").isin("2.0")).orderBy("case_id").limit(50).select("case_id", "version"))
query("flt08b_version_gate", "SELECT count(*) FILTER (WHERE version IS NULL OR version NOT IN ('1.0', '1.1')) = 0 AS passed FROM cases WHERE occurred_at < TIMESTAMP '1999-01-01'")(
    lambda w: D.assert_versions(w.cases.where("occurred_at < timestamp_ntz'1999-01-01'"), "version", ["1.0", "1.1"]))
query("flt09_field_present", "SELECT case_id, count(*) FILTER (WHERE tool = 'inspect_evidence' AND NOT failed) > 0 OR bool_or(amount > 90000) AS present FROM actions GROUP BY 1")(
    lambda w: w.actions.groupBy("case_id").agg((F.count_if((F.col("tool") == "inspect_evidence") & ~F.col("failed")) > 0).alias("a"), F.bool_or(F.col("amount") > 90000).alias("b")).select("case_id", (F.col("a") | F.col("b")).alias("present")))
query("flt10_first_match", "SELECT case_id, min(n) FILTER (WHERE cited LIKE '%@9.9') AS first_bad FROM steps GROUP BY 1")(
    lambda w: w.actions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", "part", "supp", "amount", "cited"))).alias("a")).select("case_id", F.expr("nullif(array_position(transform(a, x -> endswith(x.cited, '@9.9')), true), 0)").alias("first_bad")))
query("flt11_policy_key", "SELECT case_id, policy_id || '@' || version AS policy_key FROM cases")(lambda w: w.cases.select("case_id", F.concat_ws("@", "policy_id", "version").alias("policy_key")))
query("flt12_enrich", "SELECT case_id, template, split, version AS policy_version, 'temporal' AS dataset, version = '2.0' AS is_eval FROM cases")(lambda w: w.cases.select("case_id", "template", "split", F.col("version").alias("policy_version"), F.lit("temporal").alias("dataset"), (F.col("version") == "2.0").alias("is_eval")))
query("flt13_tag_any", "SELECT case_id FROM (SELECT case_id, [difficulty, split] AS tags FROM cases) WHERE len(list_filter(tags, lambda t: contains(t, 'URGENT') OR contains(t, 'test'))) > 0")(
    lambda w: w.orders.where(F.exists(F.array("difficulty", "split"), lambda t: t.contains("URGENT") | t.contains("test"))).select("case_id"))
query("flt15_pref_bucket", "SELECT item_id, CASE WHEN contains(s, 'stale') THEN 'stale' WHEN contains(s, 'unsafe') THEN 'unsafe' WHEN contains(s, 'invalid_tool') THEN 'invalid_tool' ELSE 'other' END AS bucket FROM (SELECT item_id, lower(text || CASE item_id % 4 WHEN 0 THEN ' Stale unsafe' WHEN 1 THEN ' UNSAFE' WHEN 2 THEN ' invalid_tool' ELSE '' END) AS s FROM benchmark)", world=False)(
    lambda w: w.table("benchmark").select("item_id", X.preference_bucket(F.concat("text", F.when(F.col("item_id") % 4 == 0, " Stale unsafe").when(F.col("item_id") % 4 == 1, " UNSAFE").when(F.col("item_id") % 4 == 2, " invalid_tool").otherwise(""))).alias("bucket")))

# Joins
def pairs_of(runs):  # noqa: ANN001, ANN201
    """Each success with each failure of the same customer and template; runs are made once."""
    failed = runs.where("not success").select("customer", "template", F.col("case_id").alias("rejected"))
    return runs.where("success").join(failed, ["customer", "template"]).select("customer", F.col("case_id").alias("chosen"), "rejected", "expected")


query("jon04_traj_case_inner", "SELECT a.case_id, count(*) AS n_steps FROM actions a JOIN cases USING (case_id) GROUP BY 1")(lambda w: w.actions.join(w.orders.select("case_id"), "case_id").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_steps")))
query("jon05_pair_three_way", "SELECT a.customer, a.case_id AS chosen, b.case_id AS rejected, c.expected FROM checked a JOIN checked b ON a.customer = b.customer AND a.success AND NOT b.success AND a.template = b.template JOIN cases c ON c.case_id = a.case_id")(
    lambda w: pairs_of(stored(w.runs.select("customer", "template", "case_id", "expected", "success"), "runs")))
query("jon06_teacher_left", "SELECT c.case_id, t.case_id IS NULL AS missing FROM cases c LEFT JOIN (SELECT DISTINCT case_id FROM actions) t USING (case_id)")(
    lambda w: w.orders.select("case_id").join(w.actions.select("case_id").distinct().withColumn("t", F.lit(True)), "case_id", "left").select("case_id", F.col("t").isNull().alias("missing")))
query("jon07_replay_or_fallback", "SELECT c.case_id, coalesce(r.answer, 'fallback') AS answer FROM cases c LEFT JOIN checked r ON r.case_id = c.case_id AND r.success")(
    lambda w: w.orders.select("case_id").join(w.runs.where("success").select("case_id", "answer"), "case_id", "left").select("case_id", F.coalesce("answer", F.lit("fallback")).alias("answer")))
query("jon08_train_minus_eval_anti", "SELECT case_id FROM cases WHERE version <> '2.0' AND customer NOT IN (SELECT customer FROM cases WHERE version = '2.0' AND split = 'test')")(
    lambda w: w.cases.where("version <> '2.0'").join(w.cases.where("version = '2.0' and split = 'test'").select("customer"), "customer", "left_anti").select("case_id"))
query("jon09_cross_split_semi", "SELECT customer, count(DISTINCT split) AS n_splits FROM cases GROUP BY 1 HAVING count(DISTINCT split) > 1")(lambda w: w.orders.groupBy("customer").agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1"))
query("jon11_exact_reference", "SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON d.text = b.text", world=False)(
    lambda w: w.table("documents").select("doc_id", digest("text")).join(w.table("benchmark").select("item_id", digest("text")), "sha").select("item_id", "doc_id").distinct())
query("jon13_grid_cross", "SELECT version, s.split, t.mode, count(*) AS n FROM cases JOIN (VALUES ('naive'), ('date_filtered')) t(mode) ON true JOIN (SELECT DISTINCT split FROM cases) s ON s.split = cases.split GROUP BY ALL")(
    lambda w: w.cases.crossJoin(F.broadcast(w.spark.createDataFrame([("naive",), ("date_filtered",)], "mode string"))).groupBy("version", "split", "mode").agg(F.count(F.lit(1)).alias("n")))
query("jon14_clause_fallback", "SELECT a.case_id, a.step, a.part, coalesce(p.policy_key, q.policy_key) AS found FROM actions a JOIN cases c USING (case_id) LEFT JOIN policies p ON p.policy_key = a.cited LEFT JOIN policies q ON q.policy_key = c.policy_key")(
    lambda w: w.actions.join(w.cases.select("case_id", "policy_key"), "case_id").join(F.broadcast(w.policies.select(F.col("policy_key").alias("p"))), F.col("cited") == F.col("p"), "left")
    .join(F.broadcast(w.policies.select(F.col("policy_key").alias("q"))), F.col("policy_key") == F.col("q"), "left").select("case_id", "step", "part", F.coalesce("p", "q").alias("found")))
query("jon17_unknown_cases", "SELECT case_id FROM cases WHERE case_id NOT IN (SELECT l_orderkey FROM lineitem)")(lambda w: w.orders.select("case_id").join(w.table("lineitem").select(F.col("l_orderkey").alias("case_id")), "case_id", "left_anti"))

# Sets
query("set01_pairwise_intersect", "SELECT a.split AS one, b.split AS two, count(*) AS n FROM (SELECT DISTINCT split, customer FROM cases) a JOIN (SELECT DISTINCT split, customer FROM cases) b ON a.customer = b.customer AND a.split < b.split GROUP BY 1, 2")(
    lambda w: w.orders.select("customer", F.col("split").alias("one")).distinct().join(w.orders.select("customer", F.col("split").alias("two")).distinct(), "customer").where("one < two").groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")))
query("set02_except", "SELECT version FROM (SELECT DISTINCT version FROM cases EXCEPT SELECT v FROM (VALUES ('1.0'), ('1.1')) t(v))")(lambda w: w.cases.select("version").distinct().subtract(w.spark.createDataFrame([("1.0",), ("1.1",)], "version string")))
query("set03_citation_union", "SELECT case_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT case_id, cited AS k FROM actions UNION ALL SELECT a.case_id, c.policy_key FROM actions a JOIN cases c USING (case_id)) GROUP BY 1")(
    lambda w: w.actions.join(w.cases.select("case_id", "policy_key"), "case_id").groupBy("case_id").agg(F.collect_set("cited").alias("a"), F.collect_set("policy_key").alias("b")).select("case_id", F.concat_ws(",", F.array_sort(F.array_union("a", "b"))).alias("keys")))
query("set04_union_all", "SELECT case_id, 'baseline' AS agent FROM cases WHERE split = 'test' UNION ALL SELECT case_id, 'rag' FROM cases WHERE split <> 'train'")(
    lambda w: w.orders.where("split = 'test'").select("case_id", F.lit("baseline").alias("agent")).unionByName(w.orders.where("split <> 'train'").select("case_id", F.lit("rag").alias("agent"))))
query("set05_merge_priority", "SELECT customer, max_by(price, case_id) AS price FROM cases GROUP BY 1")(lambda w: w.orders.withColumn("k", F.row_number().over(Window.partitionBy("customer").orderBy(F.desc("case_id")))).where("k = 1").select("customer", "price"))
query("set06_set_equality", "SELECT domain, count(DISTINCT version) = 3 AS complete FROM cases GROUP BY 1")(lambda w: w.cases.groupBy("domain").agg(F.collect_set("version").alias("v")).select("domain", (F.size(F.array_except(F.array(F.lit("1.0"), F.lit("1.1"), F.lit("2.0")), "v")) == 0).alias("complete")))
query("set07_unique_texts", "SELECT doc_id FROM documents d WHERE source = 'src1' AND length(text) >= 40 AND NOT EXISTS (SELECT 1 FROM documents o WHERE o.source <> 'src1' AND o.text = d.text)", world=False)(
    lambda w: w.table("documents").where("source = 'src1' and length(text) >= 40").select("doc_id", digest("text")).join(w.table("documents").where("source <> 'src1'").select(digest("text")).distinct(), "sha", "left_anti").select("doc_id"))

# Windows, sorts, limits
query("win06_hash_sample", "SELECT case_id FROM cases ORDER BY ('0x' || substr(sha256('42:' || case_id), 1, 8))::BIGINT, case_id LIMIT 100")(lambda w: w.orders.orderBy(X.hash_order(42, F.col("case_id")), "case_id").limit(100).select("case_id"))
query("win07_round_robin", "SELECT case_id, k FROM (SELECT case_id, domain, row_number() OVER (PARTITION BY domain ORDER BY case_id) AS k FROM cases) ORDER BY k, domain LIMIT 60")(
    lambda w: w.orders.withColumn("k", row_n(Window.partitionBy("domain").orderBy("case_id"))).where("k <= 60").orderBy("k", "domain").limit(60).select("case_id", "k"))
query("win08_diversity", "SELECT case_id FROM (SELECT case_id, domain, row_number() OVER (PARTITION BY template ORDER BY domain, case_id) AS k FROM cases) ORDER BY k > 1, domain, case_id LIMIT 40")(
    lambda w: D.first_of_each(w.orders, "template", 40, "domain", "case_id").select("case_id"))
query("win09_first_last_step", "SELECT case_id, max(n) AS n_steps, arg_max(tool, n) AS last_tool, coalesce(min(n) FILTER (WHERE tool = 'finalize_case'), 0) AS first_finalize FROM steps GROUP BY 1")(
    lambda w: w.actions.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", "part", "supp", "amount", "tool"))).alias("a")).select("case_id", F.size("a").cast("long").alias("n_steps"), F.element_at("a", -1)["tool"].alias("last_tool"), F.array_position(F.col("a.tool"), "finalize_case").alias("first_finalize")))
query("win11_first_diff", "WITH t AS (SELECT conv_id, string_split(min(text) FILTER (WHERE turn = 0), ' ') AS a, string_split(min(text) FILTER (WHERE turn = 1), ' ') AS b FROM conversations GROUP BY 1) SELECT conv_id, coalesce((SELECT min(i) FROM range(1, 1 + least(len(a), len(b))) r(i) WHERE a[i] <> b[i]), 0) AS first_diff FROM t WHERE a IS NOT NULL AND b IS NOT NULL", world=False)(
    lambda w: w.table("conversations").groupBy("conv_id").agg(F.split(F.min(F.when(F.col("turn") == 0, F.col("text"))), " ").alias("a"), F.split(F.min(F.when(F.col("turn") == 1, F.col("text"))), " ").alias("b")).where("a is not null and b is not null")
    .select("conv_id", F.expr("array_position(zip_with(slice(a, 1, least(size(a), size(b))), slice(b, 1, least(size(a), size(b))), (x, y) -> x <> y), true)").alias("first_diff")))
query("win12_bigrams", "SELECT item_id, i, t[i] || '_' || t[i + 1] AS bigram FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_@.-]+') AS t FROM benchmark))", world=False)(
    lambda w: w.table("benchmark").select("item_id", F.posexplode(X.bigrams(X.tokens(F.col("text")))).alias("p", "bigram")).select("item_id", (F.col("p") + 1).cast("long").alias("i"), "bigram"))
query("srt02_keyword_top10", "WITH q AS (SELECT unnest(['the', 'and', 'thing', 'la']) AS w) SELECT doc_id, score FROM (SELECT doc_id, round(count(*) FILTER (WHERE contains(lower(text), w)) / 4.0, 6) AS score FROM documents, q GROUP BY 1) ORDER BY score DESC, doc_id LIMIT 10", world=False)(
    lambda w: w.table("documents").select("doc_id", F.round(sum(F.lower("text").contains(t).cast("int") for t in ("the", "and", "thing", "la")) / 4.0, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10))
query("srt06_budget_topn", "SELECT case_id, version FROM cases ORDER BY CASE version WHEN '1.0' THEN 0.2 WHEN '1.1' THEN 0.6 ELSE 1.0 END DESC, case_id LIMIT 50")(
    lambda w: w.cases.orderBy(F.desc(F.when(F.col("version") == "1.0", 0.2).when(F.col("version") == "1.1", 0.6).otherwise(1.0)), "case_id").limit(50).select("case_id", "version"))
query("srt07_prefix_limit", "SELECT case_id FROM cases ORDER BY occurred_at, case_id LIMIT 25")(lambda w: w.orders.orderBy("occurred_at", "case_id").limit(25).select("case_id"))

# Environment as windows over the ordered calls
query("env02_stale_guard", "SELECT case_id, n, last_value(CASE WHEN tool = 'retrieve_policy' THEN cited END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS selected FROM steps")(
    lambda w: w.actions.select("case_id", row_n(STEPS()).alias("n"), F.last(F.when(F.col("tool") == "retrieve_policy", F.col("cited")), True).over(STEPS().rowsBetween(Window.unboundedPreceding, -1)).alias("selected")))
query("env03_finalized_guard", "SELECT case_id, n, coalesce(bool_or(tool = 'finalize_case') OVER (PARTITION BY case_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS finalized FROM steps")(
    lambda w: w.actions.select("case_id", row_n(STEPS()).alias("n"), F.coalesce(F.max(F.col("tool") == "finalize_case").over(STEPS().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("finalized")))
query("env04_status_fold", "SELECT case_id, n, coalesce(last_value(CASE WHEN failed THEN NULL WHEN tool = 'release_item' THEN 'released' WHEN tool = 'quarantine_item' THEN 'quarantined' WHEN tool = 'finalize_case' THEN 'closed' END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY n), 'open') AS status FROM steps")(
    lambda w: w.actions.select("case_id", row_n(STEPS()).alias("n"), F.coalesce(F.last(F.when(F.col("failed"), None).when(F.col("tool") == "release_item", "released").when(F.col("tool") == "quarantine_item", "quarantined").when(F.col("tool") == "finalize_case", "closed"), True).over(STEPS().rowsBetween(Window.unboundedPreceding, 0)), F.lit("open")).alias("status")))
query("env01_gate_errors", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'unknown_tool' WHEN json_extract_string(props, '$.k') IS NULL OR CAST(json_extract_string(props, '$.k') AS INT) > 95 THEN 'invalid_arguments' WHEN event_type = 'purchase' AND value < 10 THEN 'permission_denied' ELSE 'ok' END AS code FROM events", world=False)(
    lambda w: w.table("events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int")).select("event_id", F.when(F.col("event_type") == "signup", "unknown_tool").when(F.col("k").isNull() | (F.col("k") > 95), "invalid_arguments").when((F.col("event_type") == "purchase") & (F.col("value") < 10), "permission_denied").otherwise("ok").alias("code")))
query("ext_tumbling_audit", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", world=False)(
    lambda w: w.table("events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "n", "total"))
query("ext_session_audit", "SELECT user_id, count(*) AS n_sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap IS NULL OR gap >= INTERVAL 6 HOURS GROUP BY 1", world=False)(
    lambda w: w.table("events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions")))
