"""Chains of versions that supersede each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.frames import stored


def chains(links: DataFrame, key: str, supersedes: str) -> DataFrame:
    """key, head (the version at the end of its chain, which supersedes nothing), depth (links up to there), cyclic.

    Pointer doubling: in each round every version's pointer jumps to where its target's pointer leads, so a chain of n links takes log2(n)
    rounds, each one join of the versions that haven't arrived. A version that hasn't after as many rounds as all rows allow leads
    into a cycle; its head and depth are null. A version that supersedes an unknown one is a head. Keys are unique and not null.
    """
    known = links.select(F.col(key).alias("at"), F.lit(True).alias("known"))
    first = links.select(F.col(key).alias("key"), F.col(supersedes).alias("at")).join(known, "at", "left")
    state = stored(first.select("key", F.when(F.col("known"), F.col("at")).otherwise(F.col("key")).alias("at"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth"), F.col("known").isNull().alias("arrived")), "chains")
    rows, jumped = state.count(), 1
    while jumped <= rows and not (moving := state.where("not arrived")).isEmpty():
        target = state.select(F.col("key").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.col("arrived").alias("there"))
        moved = moving.join(target, "at").select("key", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("arrived"))
        state = stored(state.where("arrived").unionByName(moved), "chains")
        jumped *= 2
    arrived = F.col("arrived")
    return state.select(F.col("key").alias(key), F.when(arrived, F.col("at")).alias("head"), F.when(arrived, F.col("depth")).alias("depth"), (~arrived).alias("cyclic"))
