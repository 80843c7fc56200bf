"""Is a guard being called?  Last sighting and count per agent and event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import human_age


def heartbeat(events: DataFrame, agent: str = "agent", event: str = "event", at: str = "at") -> DataFrame:
    name = F.coalesce(F.nullif(F.col(event), F.lit("")), F.lit("unknown"))
    return (events.groupBy(F.col(agent).alias("agent"), name.alias("event"))
            .agg(F.max(at).alias("last_seen"), F.count("*").alias("cnt")))


def merge_heartbeats(old: DataFrame, new: DataFrame) -> DataFrame:
    return (old.unionByName(new).groupBy("agent", "event")
            .agg(F.max("last_seen").alias("last_seen"), F.sum("cnt").alias("cnt")))


def agent_health(beats: DataFrame) -> DataFrame:
    """Per agent its events, newest first, and when it was last seen."""
    newest_first = F.sort_array(F.collect_list(F.struct("last_seen", "event", "cnt")), asc=False)
    return beats.groupBy("agent").agg(newest_first.alias("events"), F.max("last_seen").alias("last_seen"))


def latest_events(beats: DataFrame, k: int = 4) -> DataFrame:
    """The k most recent events of each agent (a top-k report)."""
    order = Window.partitionBy("agent").orderBy(F.desc("last_seen"), F.desc("event"))
    return beats.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def agent_status(agents: DataFrame, installs: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Status of every known agent (agent, capability, supported, present) with its sightings."""
    joined = (agents.join(installs.select("agent").distinct().withColumn("wired", F.lit(True)), "agent", "left")
              .join(health.select("agent", "last_seen"), "agent", "left"))
    status = (F.when(F.col("last_seen").isNotNull(), F.concat(F.lit("firing, last seen "), human_age(F.col("last_seen"), now)))
              .when(~F.col("present"), "not installed")
              .when(F.col("wired"), "wired, but has never fired")
              .when(F.col("supported"), "detected, not wired")
              .otherwise("detected, no adapter yet"))
    return joined.withColumn("status", status).drop("wired")


def protected(health: DataFrame) -> DataFrame:
    """One row: has any agent ever been seen?"""
    return health.agg(F.coalesce(F.bool_or(F.col("last_seen").isNotNull()), F.lit(False)).alias("protected"))
