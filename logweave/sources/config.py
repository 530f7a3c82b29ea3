"""Configured data sources and the readers behind their types."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.sources import exports, files

# Fixed value: types that push their data and need no poller.
PUSHED_TYPES = ("telegraf",)

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}


def register_reader(kind: str) -> Callable[[Reader], Reader]:
    """Add a reader (spark, path of the landed data, options) -> (source, line, ..) for a source type."""

    def add(fn: Reader) -> Reader:
        READERS[kind] = fn
        return fn

    return add


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "body")


@register_reader("filetail")
def _filetail(spark: SparkSession, path: str) -> DataFrame:
    return files.scan_text_logs(spark, path)


@register_reader("datadog")
def _datadog(spark: SparkSession, path: str, os: str = "unknown") -> DataFrame:
    return exports.ingest_export_pages(_documents(spark, path), os=os)


@register_reader("splunk")
def _splunk(spark: SparkSession, path: str) -> DataFrame:
    return exports.ingest_ndjson_raw(_documents(spark, path))


@register_reader("thousandeyes")
def _thousandeyes(spark: SparkSession, path: str, os: str = "unknown") -> DataFrame:
    return exports.ingest_alert_lines(_documents(spark, path), os=os)


@register_reader("dcim_http")
def _dcim(spark: SparkSession, path: str) -> DataFrame:
    landed = spark.read.schema("url string, status int, body string, source_id bigint").json(path)
    return exports.wrap_http_payloads(landed)


@register_reader("snmp")
def _snmp(spark: SparkSession, path: str) -> DataFrame:
    landed = spark.read.schema("host string, port int, oid string, value string, source_id bigint").json(path)
    return exports.wrap_snmp_readings(landed)


def read_source(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """Lines of a source; ``options`` come from its configuration, such as ``os``, the hint that exports
    put into the source name."""
    if kind not in READERS:
        raise ValueError(f"no reader for source type {kind!r}")
    return READERS[kind](spark, path, **options)


def read_config_file(spark: SparkSession, path: str) -> dict:
    """A configuration file, JSON or YAML, from any store that Spark reads; an empty one is an empty dict."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].strip():
        return {}
    try:
        return json.loads(text[0])
    except ValueError:
        import yaml  # only files in that form need it

        return yaml.safe_load(text[0]) or {}


def reconcile_sources(sources: DataFrame, running: DataFrame) -> DataFrame:
    """What to start and stop so that the running pollers match the enabled sources: (id, action).

    A running poller stops when its source is gone or disabled; pushed types are never started.
    """
    enabled = sources.filter("enabled")
    stop = running.select("id").join(enabled.select("id"), "id", "left_anti")
    start = enabled.filter(~F.col("type").isin(*PUSHED_TYPES)).select("id").join(running.select("id"), "id", "left_anti")
    return stop.withColumn("action", F.lit("stop")).unionByName(start.withColumn("action", F.lit("start")))


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.col("id").desc())
