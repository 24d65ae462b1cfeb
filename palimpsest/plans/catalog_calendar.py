"""Queries on a calendar of given size: every order opens a version of its customer's contract.

A third of all contracts and shipments belong to one holder. Contracts overlap; every fiftieth has no end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import asof as A
from palimpsest.operators import datasets as D
from palimpsest.operators import temporal as T
from palimpsest.operators.frames import numbered
from palimpsest.operators.supersession import chains
from palimpsest.plans.projection import World
from palimpsest.plans.registry import query

day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
HOLDER = "if(o_custkey % 3 = 0, 0, o_custkey)"


def contracts(w: World) -> DataFrame:
    rows = w.table("orders").selectExpr(
        "o_orderkey as contract", f"{HOLDER} as holder", "concat('d', o_custkey % 3) as domain", "concat('CON-', o_custkey) as policy_id", "cast(o_orderkey as string) as version",
        "o_orderdate as effective_at", "if(o_orderkey % 50 = 0, null, o_orderdate + make_dt_interval(cast(o_orderkey % 400 as int))) as expires_at")
    return rows.withColumn("policy_key", F.concat_ws("@", "policy_id", "version"))


def shipments(w: World) -> DataFrame:
    line = w.table("lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("shipped"))
    return line.join(w.table("orders").selectExpr("o_orderkey as case_id", f"{HOLDER} as holder"), "case_id")


SQL = """
WITH contracts AS (SELECT o_orderkey AS contract, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS holder, 'd' || (o_custkey % 3) AS domain, 'CON-' || o_custkey AS policy_id, o_orderkey::VARCHAR AS version,
  o_orderdate AS effective_at, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate + to_days((o_orderkey % 400)::INTEGER) END AS expires_at, 'CON-' || o_custkey || '@' || o_orderkey AS policy_key FROM orders),
shipments AS (SELECT row_number() OVER () AS rid, l_orderkey AS case_id, l_linenumber AS step, l_partkey AS part, l_shipdate AS shipped, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END AS holder FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
starts AS (SELECT holder, effective_at, max(contract) AS active FROM contracts GROUP BY ALL)
"""
LAST = "SELECT s.case_id, s.step, s.part, c.active FROM shipments s ASOF LEFT JOIN starts c ON s.holder = c.holder AND s.shipped >= c.effective_at"
OPEN = """, seen AS (SELECT rid, max({'a': effective_at, 'c': contract}) AS m FROM shipments s JOIN contracts c ON s.holder = c.holder AND c.effective_at <= s.shipped AND (c.expires_at IS NULL OR s.shipped < c.expires_at) GROUP BY rid)
SELECT case_id, step, part, m.c AS active FROM shipments LEFT JOIN seen USING (rid)"""


def active(w: World) -> DataFrame:
    """Each shipment with its holder's contract in force, of those open the one that began last."""
    windows = contracts(w).select("holder", "effective_at", "expires_at", F.col("contract").alias("active"))
    return A.in_force(shipments(w), windows, ["holder"], "shipped", "effective_at", "expires_at", ["active"])


query("jon01b_asof_given_calendar", SQL + LAST, world=False)(
    lambda w: A.asof(shipments(w), contracts(w).withColumn("active", F.col("contract")), ["holder"], "shipped", "effective_at", ["active"]).select("case_id", "step", "part", "active"))
query("jon01c_overlapping_windows", SQL + OPEN, world=False)(lambda w: active(w).select("case_id", "step", "part", "active"))
query("jon02b_stale_given_calendar", f"{SQL}, shown AS ({LAST}) SELECT case_id, count(*) AS n, count(*) FILTER (WHERE active IS DISTINCT FROM case_id) AS n_stale FROM shown GROUP BY 1", world=False)(
    lambda w: A.asof(shipments(w), contracts(w).withColumn("active", F.col("contract")), ["holder"], "shipped", "effective_at", ["active"])
    .groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("active").eqNullSafe(F.col("case_id"))).alias("n_stale")))

# The catalogue itself
query("flt02_domain_filter", SQL + "SELECT policy_key, strftime(effective_at, '%Y-%m-%d') AS effective_at FROM contracts WHERE domain = 'd1'", world=False)(
    lambda w: contracts(w).where("domain = 'd1'").select("policy_key", day("effective_at")))
query("flt03_available_policies", SQL + "SELECT policy_key FROM contracts WHERE domain = 'd1' AND effective_at <= TIMESTAMP '1998-01-01' AND (expires_at IS NULL OR TIMESTAMP '1998-01-01' < expires_at)", world=False)(
    lambda w: contracts(w).where((F.col("domain") == "d1") & T.in_force(F.lit("1998-01-01").cast("timestamp_ntz"), F.col("effective_at"), F.col("expires_at"))).select("policy_key"))
query("srt01_catalogue", SQL + "SELECT policy_key, row_number() OVER (ORDER BY domain, effective_at, contract) AS ord FROM contracts", world=False)(
    lambda w: numbered(contracts(w), "ord", "domain", "effective_at", "contract").select("policy_key", "ord"))
query("win10_lead_expiry", SQL + "SELECT policy_key, strftime(lead(effective_at) OVER (PARTITION BY policy_id ORDER BY effective_at, contract), '%Y-%m-%d') AS next_start FROM contracts", world=False)(
    lambda w: contracts(w).withColumn("next_start", F.lead("effective_at").over(Window.partitionBy("policy_id").orderBy("effective_at", "contract"))).select("policy_key", day("next_start")))

# Which contract supersedes which
FOLLOWS = "SELECT contract, lag(contract) OVER (PARTITION BY policy_id ORDER BY effective_at, contract) AS supersedes FROM contracts"
RANKED = """, up AS (SELECT contract, contract AS head, 0::BIGINT AS depth FROM links WHERE supersedes IS NULL UNION ALL SELECT l.contract, u.head, u.depth + 1 FROM up u JOIN links l ON l.supersedes = u.contract)
SELECT l.contract, u.head, u.depth, u.contract IS NULL AS cyclic FROM links l LEFT JOIN up u USING (contract)"""
query("jon16_supersession", f"{SQL.replace('WITH', 'WITH RECURSIVE', 1)}, links AS MATERIALIZED ({FOLLOWS}){RANKED}", world=False)(
    lambda w: chains(contracts(w).withColumn("supersedes", F.lag("contract").over(Window.partitionBy("policy_id").orderBy("effective_at", "contract"))), "contract", "supersedes"))
# One chain of 12,000 contracts, and further ones that lead into a cycle of seven.
LONG = "case when o_orderkey = 0 then null when o_orderkey % 12000 = 0 then o_orderkey + 6 else o_orderkey - 1 end"
query("jon16b_long_chain", f"WITH RECURSIVE links AS MATERIALIZED (SELECT o_orderkey AS contract, {LONG} AS supersedes FROM orders){RANKED}", world=False)(
    lambda w: chains(w.table("orders").selectExpr("o_orderkey as contract", f"{LONG} as supersedes"), "contract", "supersedes"))

# A contract as a text
STAMPED = """'{"domain":"' || domain || '","effective_at":"' || strftime(effective_at, '%Y-%m-%dT%H:%M:%SZ') || '","expires_at":' || coalesce('"' || strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') || '"', 'null')
  || ',"policy_id":"' || policy_id || '","policy_key":"' || policy_key || '","version":"' || version || '"}'"""
moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
query("hsh04_document_checksum", f"{SQL} SELECT policy_key, sha256({STAMPED}) AS checksum FROM contracts", world=False)(
    lambda w: contracts(w).select("domain", moment("effective_at"), moment("expires_at"), "policy_id", "policy_key", "version")
    .select("policy_key", F.sha2(D.canonical_json("domain", "effective_at", "expires_at", "policy_id", "policy_key", "version"), 256).alias("checksum")))
query("str09_index_text", SQL + "SELECT policy_key, concat_ws(' ', policy_key, domain, strftime(effective_at, '%Y-%m-%d')) AS text FROM contracts", world=False)(
    lambda w: contracts(w).select("policy_key", F.concat_ws(" ", "policy_key", "domain", day("effective_at")).alias("text")))
query("flt05_parse_versions", "SELECT item_id, array_to_string(list_filter(v, lambda x, i: x <> '' AND list_position(v, x) = i), ',') AS versions FROM (SELECT item_id, list_transform(string_split(text, ','), lambda x: trim(x)) AS v FROM benchmark)", world=False)(
    lambda w: w.table("benchmark").select("item_id", F.concat_ws(",", F.array_distinct(F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != ""))).alias("versions")))
