"""Which version of a policy is in force, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import asof
from palimpsest.operators.frames import BROADCAST_BYTES


def in_force(at: Column, start: Column, end: Column) -> Column:
    """Half-open window: start <= at < end, a null end is open."""
    return (start <= at) & (end.isNull() | (at < end))


def resolve_active(cases: DataFrame, policies: DataFrame, few: bool = False) -> DataFrame:
    """Each case with the policy of its domain in force at occurred_at (null if none); windows of a domain don't overlap.

    A calendar within a checked size, or one that the caller knows to be literal (`few`), is broadcast, as a domain's versions are then
    few; any other is met by an as-of join.
    """
    if few or policies.count() * 256 <= BROADCAST_BYTES:
        p = F.broadcast(policies.select(F.col("domain").alias("_d"), "policy_id", "version", "policy_key", F.col("effective_at").alias("_a"), F.col("expires_at").alias("_b")))
        return cases.join(p, (F.col("domain") == F.col("_d")) & in_force(F.col("occurred_at"), F.col("_a"), F.col("_b")), "left").drop("_d", "_a", "_b")
    return asof.in_force(cases, policies, ["domain"], "occurred_at", "effective_at", "expires_at", ["policy_id", "version", "policy_key"])


def latest_active(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """As resolve_active, for calendars whose windows may overlap: the latest start wins, then the largest version."""
    w = Window.partitionBy("case_id").orderBy(F.desc_nulls_last("effective_at"), F.desc("version"))
    p = F.broadcast(policies.select(F.col("domain").alias("_d"), "version", "effective_at", F.col("expires_at").alias("_b")))
    j = cases.join(p, (F.col("domain") == F.col("_d")) & in_force(F.col("occurred_at"), F.col("effective_at"), F.col("_b")), "left")
    return j.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_d", "_b")


def stale(cited: Column, active_key: Column, known: Column, effective: Column) -> Column:
    """Unknown counts as stale; without an active policy what isn't effective is; else what isn't the active one."""
    return F.when(known.isNull(), True).when(active_key.isNull(), ~effective).otherwise(cited != active_key)


def stale_flags(actions: DataFrame, cases: DataFrame, policies: DataFrame) -> DataFrame:
    """Each action with `stale`: its cited key against the policy in force for its case."""
    known = F.broadcast(policies.select(F.col("policy_key").alias("known"), "effective_at", "expires_at"))
    j = actions.join(cases.select("case_id", "occurred_at", "policy_key"), "case_id").join(known, F.col("cited") == F.col("known"), "left")
    flag = stale(F.col("cited"), F.col("policy_key"), F.col("known"), in_force(F.col("occurred_at"), F.col("effective_at"), F.col("expires_at")))
    return j.withColumn("stale", flag).drop("effective_at", "expires_at", "known")


def stale_alternative(cases: DataFrame, policies: DataFrame) -> DataFrame:
    """The first policy of the case's domain in catalogue order that isn't in force then; else the id with version 0.0-stale."""
    p = F.broadcast(policies.select(F.col("domain").alias("_d"), F.col("policy_key").alias("other"), F.col("version").alias("_v"), "effective_at"))
    w = Window.partitionBy("case_id").orderBy("effective_at", "_v")
    j = cases.join(p, (F.col("domain") == F.col("_d")) & (F.col("other") != F.col("policy_key")), "left").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return j.withColumn("alternative", F.coalesce("other", F.concat("policy_id", F.lit("@0.0-stale")))).drop("_d", "_v", "_n", "other", "effective_at")


def lead_expiry(policies: DataFrame) -> DataFrame:
    """Each policy's expiry as the next version's start, and what it supersedes."""
    w = Window.partitionBy("domain").orderBy("effective_at", "version")
    return policies.withColumn("next_start", F.lead("effective_at").over(w)).withColumn("supersedes", F.lag("version").over(w))
