"""Batches pushed by agents: admission, routing and per-agent statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logweave.functions import text as T

# Source written for each log-like metric name.
LOG_SOURCES = {
    "macos_log": "Mac.log:telegraf",
    "linux_log": "Linux.log:telegraf",
    "windows_log": "Windows_2k.log:telegraf",
}

METRIC_FIELDS = "struct<name:string,tags:map<string,string>,fields:map<string,string>,timestamp:bigint>"


def admit_agent_batches(batches: DataFrame, agents: DataFrame) -> DataFrame:
    """Add source_id, agent_name, admitted and reason to batches.

    ``batches`` has batch_id, token, agent_id and metrics; ``agents`` has id, name, enabled, token,
    agent_id and allowed_hosts. The agent with the lowest id that fits the token, and the agent id
    where both sides have one, is taken. With an allow-list, one host of the batch must be on it.
    """
    known = agents.filter(F.col("enabled") & (T.or_empty(F.col("token")) != "")).groupBy("token").agg(
        F.array_sort(F.collect_list(F.struct("id", "name", T.or_empty(F.col("agent_id")).alias("agent_id"), "allowed_hosts"))).alias("_agents")
    )
    asked = T.or_empty(F.col("agent_id"))
    fits = F.filter(
        "_agents", lambda a: (a["agent_id"] == "") | (asked == "") | (a["agent_id"] == asked)
    )
    hosts = F.array_distinct(F.transform("metrics", lambda m: T.or_empty(m["tags"]["host"])))
    joined = batches.join(known, "token", "left").withColumn("_agent", F.get(fits, F.lit(0)))
    allowed = F.coalesce(F.col("_agent.allowed_hosts"), F.array().cast("array<string>"))
    on_list = F.exists(hosts, lambda h: (h != "") & F.array_contains(allowed, h))
    reason = (
        F.when(T.or_empty(F.col("token")) == "", "missing token")
        .when(F.col("_agent").isNull(), "unknown token")
        .when((F.size(allowed) > 0) & ~on_list, "host not allowed")
        .otherwise("")
    )
    return joined.select(
        *batches.columns,
        F.col("_agent.id").alias("source_id"),
        F.col("_agent.name").alias("agent_name"),
        (reason == "").alias("admitted"),
        reason.alias("reason"),
    )


def route_agent_batch(admitted: DataFrame) -> DataFrame:
    """One line per metric: named logs with a message as they are, the rest as JSON metric lines."""
    rows = admitted.select("batch_id", "source_id", F.posexplode("metrics").alias("pos", "_m"))
    name = F.lower(T.strip(T.or_empty(F.col("_m.name"))))
    message = F.col("_m.fields")["message"]
    sources = F.create_map(*[F.lit(x) for pair in LOG_SOURCES.items() for x in pair])
    is_log = name.isin(*LOG_SOURCES) & (T.or_empty(message) != "")
    host = T.or_empty(F.col("_m.tags")["host"])
    return rows.select(
        "batch_id",
        "pos",
        "source_id",
        F.when(is_log, "log").otherwise("metric").alias("kind"),
        F.when(is_log, sources[name]).otherwise(F.concat(F.lit("telegraf:"), host)).alias("source"),
        F.when(is_log, message).otherwise(F.to_json("_m")).alias("line"),
    )


def batch_counts(routed: DataFrame) -> DataFrame:
    """Accepted, log and metric lines per batch."""
    return routed.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("accepted"),
        F.count_if(F.col("kind") == "log").alias("logs_enqueued"),
        F.count_if(F.col("kind") == "metric").alias("metrics_enqueued"),
    )


def agent_stats(admitted: DataFrame) -> DataFrame:
    """Last seen and accepted lines per agent; rejected batches stand under no agent.

    Only batches without a fitting token count as rejected, as only those are counted at the door.
    """
    ok = F.col("admitted")
    rows = admitted.filter(ok | F.col("source_id").isNull())
    return rows.groupBy("source_id", "agent_name").agg(
        F.max(F.when(ok, F.col("ts"))).alias("last_seen"),
        F.sum(F.when(ok, F.size("metrics")).otherwise(0)).alias("accepted"),
        F.count_if(F.col("reason") == "unknown token").alias("rejected"),
    )
