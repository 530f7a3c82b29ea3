"""Log lines from landed exports and device readings.

Fetching is outside; these functions shape what a poller has landed, one JSON document per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions import points as P, text as T
from logweave.operators.upsert import explode_once

MINUTES_BACK = 5


def _os_hint(os: str) -> str:
    return (os or "unknown").lower()


def ingest_export_pages(pages: DataFrame, body: str = "body", os: str = "unknown") -> DataFrame:
    """Messages of log-search pages ``{"data": [{"attributes": {"message": ..}}]}``."""
    items = P.get(F.try_parse_json(F.col(body)), "$.data", "array<variant>")
    rows = explode_once(pages, items, "_item")
    message = P.get(F.col("_item"), "$.attributes.message", "string")
    return rows.withColumn("line", message).filter(F.col("line") != "").select(
        *[c for c in pages.columns if c != body],
        F.lit(f"datadog:{_os_hint(os)}").alias("source"),
        T.strip(F.col("line")).alias("line"),
    )


def ingest_ndjson_raw(lines: DataFrame, body: str = "body") -> DataFrame:
    """``result._raw`` of search-export lines; empty and unreadable ones are dropped."""
    raw = P.get(F.try_parse_json(F.col(body)), "$.result._raw", "string")
    return lines.withColumn("line", raw).filter(F.col("line") != "").select(
        *[c for c in lines.columns if c != body], F.lit("splunk:unknown").alias("source"), "line"
    )


def _first_of(item: Column, *keys: str) -> Column:
    return T.first_filled(*[P.get(item, f"$.{k}", "string") for k in keys])


def ingest_alert_lines(pages: DataFrame, body: str = "body", os: str = "unknown") -> DataFrame:
    """One readable line per network alert: rule, test, severity and text, blanks left out."""
    page = F.try_parse_json(F.col(body))
    lists = [P.get(page, f"$.{k}", "array<variant>") for k in ("alerts", "alert")]
    items = F.coalesce(F.when(F.size(lists[0]) > 0, lists[0]), lists[1])
    rows = explode_once(pages, items, "_a")
    a = F.col("_a")
    words = F.concat_ws(
        " ",
        F.coalesce(_first_of(a, "ruleName", "alertType"), F.lit("alert")),
        _first_of(a, "testName", "testId"),
        _first_of(a, "severity", "level"),
        _first_of(a, "summary", "description"),
    )
    return rows.select(
        *[c for c in pages.columns if c != body],
        F.lit(f"thousandeyes:{_os_hint(os)}").alias("source"),
        T.strip(words).alias("line"),
    )


def incremental_window(landed: DataFrame, polls: DataFrame, minutes_back: int = MINUTES_BACK) -> DataFrame:
    """Rows of each source since its previous poll, or of the last minutes at its first poll.

    ``landed`` has source_id and ts; ``polls`` has source_id, now and since (null at the first poll).
    """
    bound = F.coalesce(F.col("since"), F.col("now") - F.expr(f"INTERVAL {minutes_back} MINUTES"))
    joined = landed.join(polls.withColumn("_bound", bound), "source_id")
    return joined.filter((F.col("ts") >= F.col("_bound")) & (F.col("ts") <= F.col("now"))).select(*landed.columns)


def wrap_http_payloads(responses: DataFrame) -> DataFrame:
    """Sensor responses (url, status, body text) as one JSON line each; rows without url are skipped.

    A body that is JSON is embedded as such, any other as text.
    """
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("unknown"))
    rows = responses.filter(T.or_empty(F.col("url")) != "")
    as_json = F.to_json(F.struct("url", "status", F.try_parse_json("body").alias("body")))
    as_text = F.to_json(F.struct("url", "status", "body"))
    return rows.withColumns(
        {
            "source": F.concat(F.lit("dcim_http:"), host),
            "line": F.when(F.try_parse_json("body").isNotNull(), as_json).otherwise(as_text),
        }
    ).drop("url", "status", "body")


def wrap_snmp_readings(readings: DataFrame) -> DataFrame:
    """Device readings (host, port, oid, value) as one JSON line each, community hidden."""
    payload = F.struct(
        "host", "port", F.lit("***").alias("community"), "oid", F.col("value").cast("string").alias("value")
    )
    return readings.withColumns(
        {"source": F.concat(F.lit("snmp:"), F.col("host")), "line": F.to_json(payload)}
    ).drop("host", "port", "community", "oid", "value")
