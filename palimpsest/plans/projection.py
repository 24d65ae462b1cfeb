"""The domain's entities as frames over the star-schema tables: the only place that knows those tables.

A policy calendar of nine literal rows; orders are cases, line items the actions of a case's trajectory. `SQL` states the same
as common table expressions, for the oracles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import temporal, vector_index, verify

VERSIONS = [("1.0", "1995-01-01", "1997-01-01"), ("1.1", "1997-01-01", "1999-01-01"), ("2.0", "1999-01-01", None)]
DOMAINS = ["d0", "d1", "d2"]
TOOLS = ["retrieve_policy", "inspect_evidence", "release_item", "quarantine_item", "finalize_case", "request_missing_evidence", "create_human_review"]
KEYS = [f"POL-{d.upper()}@{v}" for d in DOMAINS for v, _, _ in VERSIONS]

_indexes: dict[tuple[str, str], vector_index.Index] = {}


class World:
    """Frames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def policies(self) -> DataFrame:
        rows = [(d, f"POL-{d.upper()}", v, a, b) for d in DOMAINS for v, a, b in VERSIONS]
        df = self.spark.createDataFrame(rows, "domain string, policy_id string, version string, a string, b string")
        return df.select("domain", "policy_id", "version", F.concat_ws("@", "policy_id", "version").alias("policy_key"), F.col("a").cast("timestamp_ntz").alias("effective_at"), F.col("b").cast("timestamp_ntz").alias("expires_at"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("case_id"), F.concat(F.lit("d"), F.col("o_custkey") % 3).alias("domain"), F.col("o_orderpriority").alias("difficulty"),
            F.col("o_orderdate").alias("occurred_at"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"),
            F.when(F.col("o_orderstatus") == "F", "release").when(F.col("o_orderstatus") == "O", "quarantine").otherwise("request_evidence").alias("expected"),
            F.when(F.col("o_orderkey") % 10 == 8, "validation").when(F.col("o_orderkey") % 10 == 9, "test").otherwise("train").alias("split"),
        ).withColumn("template", F.concat("domain", "difficulty"))

    @cached_property
    def cases(self) -> DataFrame:
        """Orders with the policy in force, the policy expected to be, and what is known of their evidence and tags.

        Every 13th case expects version 1.0, in force or not; a case within 45 days of a new year is tagged as at a version boundary.
        """
        found = temporal.resolve_active(self.orders, self.policies, few=True)
        return found.withColumns({
            "expected_key": F.when(F.col("case_id") % 13 == 0, F.concat("policy_id", F.lit("@1.0"))).otherwise(F.col("policy_key")),
            "boundary": F.dayofyear("occurred_at") <= 45, "has_evidence": F.col("case_id") % 5 != 0, "lacks_evidence": F.col("expected") == "request_evidence",
        })

    @cached_property
    def steps(self) -> DataFrame:
        """Actions with all of their case's columns: the one join that trajectories need."""
        line = self.table("lineitem").select(
            F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("amount"),
            (F.col("l_discount") > 0.08).alias("failed"),
            F.when(F.col("l_partkey") % 11 == 3, "request_missing_evidence").when(F.col("l_partkey") % 11 == 5, "create_human_review")
            .when(F.expr("l_returnflag = 'R' and l_linestatus = 'F'"), "finalize_case").when(F.expr("l_returnflag = 'N' and l_linestatus = 'O'"), "retrieve_policy")
            .when(F.expr("l_returnflag = 'N' and l_linestatus = 'F'"), "inspect_evidence").when(F.expr("l_returnflag = 'R' and l_linestatus = 'O'"), "release_item")
            .when(F.expr("l_returnflag = 'A' and l_linestatus = 'F'"), "quarantine_item").otherwise("ask_oracle").alias("tool"),
        )
        cited = F.when(F.col("supp") % 10 == 1, "9.9").when((F.col("supp") % 10 == 0) & (F.col("version") == "2.0"), "1.1").when(F.col("supp") % 10 == 0, "1.0").otherwise(F.col("version"))
        place = F.expr("cast(step as decimal(8,0)) * 1e28BD + cast(part as decimal(10,0)) * 1e18BD + cast(supp as decimal(8,0)) * 1e10BD + cast(round(amount * 100) as decimal(10,0))")
        return line.join(self.cases.hint("merge"), "case_id").withColumn("cited", F.concat_ws("@", "policy_id", cited)).withColumn("place", place.cast("decimal(36,0)"))

    @cached_property
    def actions(self) -> DataFrame:
        """Steps with tool, error and the policy key they cite."""
        return self.steps.select("case_id", "step", "part", "supp", "amount", "failed", "tool", "domain", "version", "cited")

    @cached_property
    def runs(self) -> DataFrame:
        """One row per case that has actions: the verdicts on its trajectory."""
        return verify.verdicts(self.steps, KEYS, TOOLS)

    @cached_property
    def vector_index(self) -> vector_index.Index:
        """The inverted file of the embeddings, built once in an application for each folder, as an index is built ahead of its queries."""
        key = (self.spark.sparkContext.applicationId, self.folder)
        if key not in _indexes:
            _indexes[key] = vector_index.build(self.table("embeddings"))
        return _indexes[key]

    @cached_property
    def told_runs(self) -> DataFrame:
        """The same with the tools used, in order."""
        return verify.verdicts(self.steps, KEYS, TOOLS, calls=True)


#: Common table expressions for the same entities.
SQL = """
WITH versions(version, effective_at, expires_at) AS (VALUES ('1.0', TIMESTAMP '1995-01-01', TIMESTAMP '1997-01-01'), ('1.1', TIMESTAMP '1997-01-01', TIMESTAMP '1999-01-01'), ('2.0', TIMESTAMP '1999-01-01', NULL)),
policies AS (SELECT d AS domain, 'POL-' || upper(d) AS policy_id, version, 'POL-' || upper(d) || '@' || version AS policy_key, effective_at, expires_at FROM versions, (VALUES ('d0'), ('d1'), ('d2')) t(d)),
cases0 AS (SELECT o_orderkey AS case_id, 'd' || (o_custkey % 3) AS domain, o_orderpriority AS difficulty, o_orderdate AS occurred_at, o_custkey AS customer, o_totalprice AS price,
  CASE o_orderstatus WHEN 'F' THEN 'release' WHEN 'O' THEN 'quarantine' ELSE 'request_evidence' END AS expected,
  CASE o_orderkey % 10 WHEN 8 THEN 'validation' WHEN 9 THEN 'test' ELSE 'train' END AS split, 'd' || (o_custkey % 3) || o_orderpriority AS template FROM orders),
cases AS (SELECT c.*, p.policy_id, p.version, p.policy_key, CASE WHEN case_id % 13 = 0 THEN p.policy_id || '@1.0' ELSE p.policy_key END AS expected_key, dayofyear(occurred_at) <= 45 AS boundary,
  case_id % 5 <> 0 AS has_evidence, expected = 'request_evidence' AS lacks_evidence FROM cases0 c LEFT JOIN policies p ON p.domain = c.domain AND p.effective_at <= c.occurred_at AND (p.expires_at IS NULL OR c.occurred_at < p.expires_at)),
actions AS (SELECT l_orderkey AS case_id, l_linenumber AS step, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS amount, l_discount > 0.08 AS failed,
  CASE WHEN l_partkey % 11 = 3 THEN 'request_missing_evidence' WHEN l_partkey % 11 = 5 THEN 'create_human_review' ELSE CASE l_returnflag || l_linestatus WHEN 'RF' THEN 'finalize_case' WHEN 'NO' THEN 'retrieve_policy' WHEN 'NF' THEN 'inspect_evidence' WHEN 'RO' THEN 'release_item' WHEN 'AF' THEN 'quarantine_item' ELSE 'ask_oracle' END END AS tool,
  c.domain, c.version, c.policy_id || '@' || CASE WHEN l_suppkey % 10 = 1 THEN '9.9' WHEN l_suppkey % 10 = 0 AND c.version = '2.0' THEN '1.1' WHEN l_suppkey % 10 = 0 THEN '1.0' ELSE c.version END AS cited
  FROM lineitem JOIN cases c ON l_orderkey = c.case_id),
steps AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY step, part, supp, amount) AS n FROM actions),
traj AS (SELECT s.case_id, count(*) AS n_steps, count(*) FILTER (WHERE s.failed) AS n_failed, count(*) - count(DISTINCT s.tool) AS n_repeats, arg_max(s.tool, s.n) AS last_tool, arg_min(s.tool, s.n) AS first_tool,
  string_agg(s.tool, ',' ORDER BY s.n) AS tools_used, bool_or(s.cited <> c.policy_key) AS stale, bool_or(s.cited LIKE '%@9.9') AS unknown_policy, bool_or(s.tool = 'ask_oracle') AS unknown_tool,
  bool_or(s.tool = 'retrieve_policy') AS has_retrieve, bool_or(s.tool = 'inspect_evidence') AS has_inspect, bool_or(s.tool = 'release_item') AS has_release, bool_or(s.tool = 'quarantine_item') AS has_quarantine,
  bool_or(s.tool = 'request_missing_evidence') AS has_request, bool_or(s.tool = 'create_human_review') AS has_review, bool_or(s.tool = 'finalize_case' AND NOT s.failed) AS finalized,
  arg_max(CASE s.tool WHEN 'release_item' THEN 'release' WHEN 'quarantine_item' THEN 'quarantine' WHEN 'request_missing_evidence' THEN 'request_evidence' WHEN 'create_human_review' THEN 'human_review' ELSE 'finalized' END, s.n)
    FILTER (WHERE NOT s.failed AND s.tool IN ('release_item', 'quarantine_item', 'request_missing_evidence', 'create_human_review', 'finalize_case')) AS status,
  bool_or(s.cited = c.policy_key) AS cites_active, bool_or(s.cited = c.expected_key) AS cites_expected FROM steps s JOIN cases c USING (case_id) GROUP BY s.case_id),
ans AS (SELECT t.*, c.domain, c.difficulty, c.expected, c.version, c.template, c.split, c.occurred_at, c.customer, c.policy_key, c.expected_key, c.boundary, c.has_evidence, c.lacks_evidence,
  CASE t.last_tool WHEN 'release_item' THEN 'released' WHEN 'quarantine_item' THEN 'quarantine' WHEN 'finalize_case' THEN 'awaiting_evidence' WHEN 'inspect_evidence' THEN 'evidence' WHEN 'request_missing_evidence' THEN t.last_tool WHEN 'create_human_review' THEN 'human_review' ELSE '' END AS answer
  FROM traj t JOIN cases c USING (case_id)),
runs AS (SELECT *, policy_key IS NOT DISTINCT FROM expected_key AS active_policy_match, NOT stale AS no_stale_policy, NOT unknown_policy AS no_hallucinated_policy, NOT unknown_tool AS valid_tools,
  has_retrieve AND (difficulty IN ('1-URGENT', '2-HIGH') OR has_inspect) AS required_tools, NOT (expected = 'request_evidence' AND has_release) AS no_prohibited_actions,
  (expected = 'release' AND answer = 'released') OR (expected = 'quarantine' AND answer = 'quarantine') OR (expected = 'request_evidence' AND answer IN ('awaiting_evidence', 'evidence', 'request_missing_evidence')) OR answer = '' AS answer_matches,
  CASE WHEN NOT has_evidence THEN true WHEN lacks_evidence THEN has_request ELSE has_inspect END AS evidence_handling FROM ans),
checked0 AS (SELECT *, CASE WHEN answer <> '' THEN answer_matches ELSE finalized AND expected = 'request_evidence' OR coalesce(status = expected, false) END AS correct_resolution, NOT boundary OR active_policy_match AS boundary_kept FROM runs),
checked AS (SELECT *, no_stale_policy AND no_hallucinated_policy AND valid_tools AND no_prohibited_actions AND correct_resolution AS success FROM checked0)
"""
