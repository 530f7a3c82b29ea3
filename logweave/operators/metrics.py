"""Metric payloads to points, and the points' sinks and listings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions import points as P, text as T

EXPORT_LIMIT = 1000


def source_configs(sources: DataFrame) -> DataFrame:
    """(source_id, config struct) from data sources (id, config JSON text)."""
    value = F.coalesce(F.try_parse_json(F.col("config")), F.parse_json(F.lit("{}")))
    return sources.select(F.col("id").cast("bigint").alias("source_id"), P.config_struct(value).alias("source_config"))


def with_points(
    lines: DataFrame, sources: DataFrame, normalizers: Mapping[str, P.Normalizer] | None = None
) -> DataFrame:
    """Add ``points`` to lines (source, line, source_id, ts): empty for what is not a metric.

    A metric line has a known kind, is a JSON object and yields at least one point. Lines of
    sources without config count as having an empty one.
    """
    normalizers = P.NORMALIZERS if normalizers is None else normalizers
    kind = T.source_kind(F.col("source"))
    payload = F.when(kind.isin(*normalizers), F.try_parse_json(F.col("line")))
    df = lines.withColumns({"_kind": kind, "_payload": payload})
    df = df.join(source_configs(sources), "source_id", "left")
    now_nano = F.unix_micros("ts") * 1000
    made: Column | None = None
    for name, fn in normalizers.items():
        value = fn(F.col("_payload"), F.col("source_config"), now_nano)
        cond = (F.col("_kind") == name) & P.is_object(F.col("_payload"))
        made = F.when(cond, value) if made is None else made.when(cond, value)
    points = F.coalesce(made, P.no_points()) if made is not None else P.no_points()
    return df.withColumn("points", points).select(*lines.columns, "points")


def split_metrics_logs(with_points_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric points, log lines): every line goes to exactly one side."""
    has = F.size("points") > 0
    keep = [c for c in with_points_df.columns if c != "points"]
    return metric_points(with_points_df.filter(has)), with_points_df.filter(~has).select(*keep)


def metric_points(with_points_df: DataFrame) -> DataFrame:
    """One row per point with the log_id it came from."""
    exploded = exploded_once(with_points_df, "log_id")
    return exploded.select("log_id", "point_no", "_p.*")


def exploded_once(with_points_df: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, point_no and the point ``_p``.

    The outer form is used because Spark guards an inner one with a filter on the array, which
    would compute all points twice.
    """
    rows = with_points_df.select(*keep, F.posexplode_outer("points").alias("point_no", "_p"))
    return rows.filter(F.col("_p").isNotNull())


def metrics_with_config(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Metric lines with the config text of their source, ``{}`` where there is none."""
    configs = sources.select(F.col("id").cast("bigint").alias("source_id"), F.col("config"))
    joined = lines.join(configs, "source_id", "left")
    return joined.withColumn("config", F.coalesce("config", F.lit("{}")))


def metric_stream_rows(points: DataFrame) -> DataFrame:
    """Points as text columns, maps as JSON, ready for a stream or table sink."""
    text = T.or_empty
    return points.select(
        "log_id",
        "point_no",
        text(F.col("name")).alias("name"),
        F.coalesce("type", F.lit("gauge")).alias("type"),
        text(F.col("value").cast("string")).alias("value"),
        text(F.col("unit")).alias("unit"),
        F.to_json("resource").alias("resource"),
        F.to_json("attributes").alias("attributes"),
    )


def write_metrics(points: DataFrame, path: str) -> None:
    metric_stream_rows(points).write.mode("append").parquet(path)


def metric_export_rows(points: DataFrame, limit: int | None = None) -> DataFrame:
    """Numeric points as exported: resource overlaid by attributes.

    The exporter is called once for each message: a ``limit`` asked for by the caller counts the points
    of one message, not of the table, so it takes no sort and no shuffle.
    """
    batch = points.filter(F.col("point_no") < limit) if limit is not None else points
    overlay = F.map_concat(
        F.map_filter("resource", lambda k, v: ~F.map_contains_key(F.col("attributes"), k)), F.col("attributes")
    )
    return batch.filter(F.col("value").isNotNull()).select(
        "log_id",
        "point_no",
        F.coalesce(F.nullif("name", F.lit("")), F.lit("metric.value")).alias("name"),
        F.nullif("unit", F.lit("")).alias("unit"),
        F.col("value").cast("double").alias("value"),
        overlay.alias("attributes"),
        "time_unix_nano",
    )


def export_stats(exported: DataFrame) -> DataFrame:
    """Exported points and the time of the last one."""
    return exported.agg(F.count(F.lit(1)).alias("total_exported"), F.max("time_unix_nano").alias("last_nano"))


def recent_metrics(rows: DataFrame, limit: int = 100, vendor: str | None = None, schema: str | None = None) -> DataFrame:
    """Newest points first cut to ``limit`` (1 at least), then filtered, in time order.

    ``rows`` are stream rows with an ``id`` that grows with time.
    """
    newest = rows.orderBy(F.col("id").desc()).limit(max(1, limit))
    if vendor:
        newest = newest.filter(F.get_json_object("resource", "$.vendor") == vendor)
    if schema == "redfish":
        newest = newest.filter(F.col("name").startswith("redfish."))
    return newest.orderBy("id")
