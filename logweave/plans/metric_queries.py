"""Queries over agent batches, device readings and sensor payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.functions import points as P
from logweave.operators import metrics as M
from logweave.plans import fixtures as X, oracle as O
from logweave.plans.registry import query
from logweave.session import fresh_path
from logweave.sources import agents as A, exports as E


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.admit_agent_batches(X.agent_batches(spark, sf_dir), X.agents(spark, sf_dir))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.route_agent_batch(admitted(spark, sf_dir).filter("admitted"))


@query(
    "admit_agent_batches",
    f"""WITH {O.AGENT_METRICS} SELECT batch_id, CAST(source_id AS BIGINT) AS source_id, agent_name, reason = '' AS admitted, reason FROM admitted""",
)
def admit_agent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).select("batch_id", "source_id", "agent_name", "admitted", "reason")


@query(
    "route_agent_batch",
    f"""WITH {O.AGENT_METRICS} SELECT batch_id, CAST(pos AS INTEGER) AS pos, CAST(source_id AS BIGINT) AS source_id,
      CASE WHEN is_log THEN 'log' ELSE 'metric' END AS kind,
      CASE WHEN is_log THEN 'Mac.log:telegraf' ELSE 'telegraf:' || host END AS source,
      CASE WHEN is_log THEN message ELSE name END AS shown FROM routed_metrics""",
)
def route_agent_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shown`` is the log line, or the metric name read back from the JSON line."""
    rows = routed(spark, sf_dir)
    shown = F.when(F.col("kind") == "log", F.col("line")).otherwise(F.get_json_object("line", "$.name"))
    return rows.select("batch_id", "pos", "source_id", "kind", "source", shown.alias("shown"))


@query(
    "batch_counts",
    f"""WITH {O.AGENT_METRICS} SELECT batch_id, count(*) AS accepted, count_if(is_log)::BIGINT AS logs_enqueued,
      count_if(NOT is_log)::BIGINT AS metrics_enqueued FROM routed_metrics GROUP BY 1""",
)
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.batch_counts(routed(spark, sf_dir))


@query(
    "agent_stats",
    f"""WITH {O.AGENT_METRICS} SELECT CAST(source_id AS BIGINT) AS source_id, agent_name,
      max(CASE WHEN reason = '' THEN epoch_us(ts) END) AS last_us,
      sum(CASE WHEN reason = '' THEN n ELSE 0 END)::BIGINT AS accepted, count_if(reason = 'unknown token')::BIGINT AS rejected
    FROM admitted WHERE reason = '' OR source_id IS NULL GROUP BY 1, 2""",
)
def agent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.agent_stats(admitted(spark, sf_dir))
    return stats.withColumn("last_us", F.unix_micros("last_seen")).drop("last_seen")


def _lines(rows: DataFrame) -> DataFrame:
    """Rows with the columns every normaliser input has."""
    return rows.select("log_id", "ts", "source", "line", F.col("source_id").cast("bigint").alias("source_id"))


def agent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.agent_metrics(spark, sf_dir)
    return m.select(
        F.col("event_id").alias("log_id"), "ts",
        F.concat(F.lit("telegraf:"), F.col("metric.tags")["host"]).alias("source"),
        F.to_json("metric").alias("line"),
        F.lit(None).cast("bigint").alias("source_id"),
    )


def snmp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(E.wrap_snmp_readings(X.snmp_readings(spark, sf_dir)))


def sensor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(E.wrap_http_payloads(X.sensor_payloads(spark, sf_dir)))


def points_of(lines: DataFrame, spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return M.metric_points(M.with_points(lines, X.sources(spark, sf_dir), **kwargs))


def _flat(points: DataFrame) -> DataFrame:
    """Maps as text, for comparing."""

    def text(c: str) -> Column:
        entries = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"]))
        return F.array_join(entries, ",").alias(c)

    return points.select("log_id", "point_no", "name", "type", F.round("value", 6).alias("value"), "unit", "time_unix_nano", text("resource"), text("attributes"))


def _point_sql(ctes: str, source: str) -> str:
    return f"WITH {ctes} SELECT * FROM ({source})"


TELEGRAF_ROWS = """SELECT log_id, point_no, name, 'gauge' AS type, round(value, 6) AS value, unit, nano AS time_unix_nano,
  'host=' || host || ',vendor=telegraf' AS resource, attribute AS attributes FROM agent_points"""
SNMP_ROWS = """SELECT log_id, 0 AS point_no, name, 'gauge' AS type, round(scaled, 6) AS value, 'b' AS unit, nano AS time_unix_nano,
  'host=' || host || ',vendor=snmp' AS resource, 'oid=' || oid AS attributes FROM snmp_points"""
REDFISH_ROWS = """SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY s_suppkey) - 1 AS INTEGER) AS point_no,
  'redfish.temperature.celsius' AS name, 'gauge' AS type, reading AS value, 'C' AS unit, nano AS time_unix_nano,
  'vendor=dcim_http' AS resource, 'Name=' || s_name AS attributes FROM sensors WHERE s_nationkey % 2 = 0 AND reading IS NOT NULL"""
DCIM_ROWS = """SELECT log_id, CAST(row_number() OVER (PARTITION BY log_id ORDER BY rule, s_suppkey) - 1 AS INTEGER) AS point_no,
  name, 'gauge' AS type, value, unit, nano AS time_unix_nano, 'vendor=dcim_http' AS resource, attributes FROM (
    SELECT *, 0 AS rule, 'rack.balance' AS name, reading AS value, 'C' AS unit, 'Name=' || s_name AS attributes FROM sensors WHERE reading IS NOT NULL
    UNION ALL SELECT *, 1, 'dcim.metric', s_suppkey::DOUBLE, NULL, '' FROM sensors)
  WHERE s_nationkey % 2 = 1"""


@query("normalize_telegraf", _point_sql(O.AGENT_POINTS, TELEGRAF_ROWS))
def normalize_telegraf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(points_of(agent_lines(spark, sf_dir), spark, sf_dir))


@query("normalize_snmp", _point_sql(O.SNMP, SNMP_ROWS))
def normalize_snmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(points_of(snmp_lines(spark, sf_dir), spark, sf_dir))


@query("normalize_redfish", _point_sql(O.SENSORS, REDFISH_ROWS))
def normalize_redfish(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = points_of(sensor_lines(spark, sf_dir), spark, sf_dir)
    return _flat(points).filter(F.col("name").startswith("redfish."))


@query("normalize_dcim", _point_sql(O.SENSORS, DCIM_ROWS))
def normalize_dcim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured extraction only: the Redfish preset is switched off."""
    without = dict(P.NORMALIZERS, dcim_http=lambda p, c, t: P.dcim_http(p, c, t, redfish=False))
    return _flat(points_of(sensor_lines(spark, sf_dir), spark, sf_dir, normalizers=without))


ALL_LINES = ", ".join([O.AGENT_POINTS, O.SNMP, O.SENSORS])
ALL_ROWS = f"""SELECT 'agent' AS origin, * FROM ({TELEGRAF_ROWS}) UNION ALL SELECT 'snmp', * FROM ({SNMP_ROWS})
  UNION ALL SELECT 'sensor', * FROM ({REDFISH_ROWS}) UNION ALL SELECT 'sensor', * FROM ({DCIM_ROWS})"""


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric and log lines on one stream; ids are made distinct by their origin."""
    logs = X.log_lines(spark, sf_dir).select("log_id", "ts", "source", "line", "source_id")
    parts = {
        "agent": agent_lines(spark, sf_dir), "snmp": snmp_lines(spark, sf_dir),
        "sensor": sensor_lines(spark, sf_dir), "log": logs,
    }
    both: DataFrame | None = None
    for origin, part in parts.items():
        part = part.withColumn("origin", F.lit(origin))
        both = part if both is None else both.unionByName(part)
    return both


@query("normalize_metrics", f"WITH {ALL_LINES} SELECT origin, log_id, point_no, name, value FROM ({ALL_ROWS})")
def normalize_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds in one pass; log lines give no points."""
    df = M.with_points(all_lines(spark, sf_dir), X.sources(spark, sf_dir))
    rows = M.exploded_once(df, "origin", "log_id")
    return rows.select("origin", "log_id", "point_no", "_p.name", F.round("_p.value", 6).alias("value"))


@query(
    "split_metrics_logs",
    f"""WITH {ALL_LINES}, metric AS (SELECT DISTINCT origin, log_id FROM ({ALL_ROWS})),
    sent AS (SELECT 'agent' AS origin, count(*) AS n FROM agent_metrics UNION ALL SELECT 'snmp', count(*) FROM readings
      UNION ALL SELECT 'sensor', count(DISTINCT log_id) FROM sensors UNION ALL SELECT 'log', count(*) FROM log_lines),
    used AS (SELECT origin, count(*) AS n FROM metric GROUP BY origin)
    SELECT s.origin, coalesce(u.n, 0) AS metric_lines, s.n - coalesce(u.n, 0) AS log_lines
    FROM sent s LEFT JOIN used u ON s.origin = u.origin""",
)
def split_metrics_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each origin that became metrics, and those that stayed log lines."""
    df = M.with_points(all_lines(spark, sf_dir), X.sources(spark, sf_dir))
    metric = F.size("points") > 0
    return df.groupBy("origin").agg(
        F.count_if(metric).alias("metric_lines"), F.count_if(~metric).alias("log_lines")
    )


@query(
    "metrics_with_config",
    f"""WITH {O.SNMP} SELECT r.log_id, n.n_nationkey IS NOT NULL AS configured,
      CASE WHEN n.n_nationkey IS NULL THEN '' WHEN n.n_nationkey % 2 = 0 THEN 'redfish' ELSE 'plain' END AS schema
    FROM readings r LEFT JOIN nation n ON n.n_nationkey + 1 = r.source_id""",
)
def metrics_with_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.metrics_with_config(snmp_lines(spark, sf_dir), X.sources(spark, sf_dir))
    schema = F.coalesce(F.get_json_object("config", "$.schema"), F.lit(""))
    return df.select("log_id", (F.col("config") != "{}").alias("configured"), schema.alias("schema"))


@query("metrics_sink", f"WITH {O.AGENT_POINTS} SELECT name, count(*) AS n, coalesce(unit, '') AS unit FROM agent_points GROUP BY 1, 3")
def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written to the metrics table and read back."""
    path = fresh_path(spark, "metrics")
    M.write_metrics(points_of(agent_lines(spark, sf_dir), spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("name", "unit").agg(F.count(F.lit(1)).alias("n"))


EXPORT_ROWS = """SELECT log_id, point_no, name, unit, round(value, 6) AS value, nano AS time_unix_nano,
  CASE WHEN attribute LIKE 'device%' THEN attribute || ',host=' || host ELSE 'host=' || host END
  || CASE WHEN attribute LIKE 'path%' THEN ',' || attribute ELSE '' END || ',vendor=telegraf' AS attributes FROM agent_points"""


def _export(spark: SparkSession, sf_dir: str, limit: int | None) -> DataFrame:
    return M.metric_export_rows(points_of(agent_lines(spark, sf_dir), spark, sf_dir), limit)


@query("metric_export_rows", f"WITH {O.AGENT_POINTS} {EXPORT_ROWS}")
def metric_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point as exported, batch size left off."""
    rows = _export(spark, sf_dir, None).withColumn("resource", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))).withColumn("type", F.lit(""))
    return _flat(rows).drop("resource", "type")


@query(
    "metric_export_batch",
    f"WITH {O.AGENT_POINTS} SELECT log_id, point_no, name, round(value, 6) AS value FROM agent_points WHERE point_no < 1000",
)
def metric_export_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exporter's calls: up to 1,000 points of each message."""
    return _export(spark, sf_dir, M.EXPORT_LIMIT).select("log_id", "point_no", "name", F.round("value", 6).alias("value"))


@query("export_stats", f"WITH {O.AGENT_POINTS} SELECT count(*) AS total_exported, max(nano) AS last_nano FROM agent_points")
def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.export_stats(_export(spark, sf_dir, None))


@query(
    "recent_metrics",
    f"""WITH {ALL_LINES}, rows AS (SELECT origin, * EXCLUDE origin FROM ({ALL_ROWS}) WHERE origin = 'sensor'),
    ids AS (SELECT log_id * 1000 + point_no AS id, name, value FROM rows ORDER BY id DESC LIMIT 200)
    SELECT id, name, round(value, 6) AS value FROM ids WHERE starts_with(name, 'redfish.')""",
)
def recent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 sensor points, of which the Redfish ones."""
    points = points_of(sensor_lines(spark, sf_dir), spark, sf_dir)
    rows = M.metric_stream_rows(points).withColumn("id", F.col("log_id") * 1000 + F.col("point_no"))
    found = M.recent_metrics(rows, 200, vendor="dcim_http", schema="redfish")
    return found.select("id", "name", F.round(F.col("value").cast("double"), 6).alias("value"))
