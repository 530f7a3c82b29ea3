"""Alerts: read side, persist marks, feedback and the classification rows they come from.

An alert row has ms and seq (its stream position), id, type, os, issue_key, cluster_id,
failure_type, confidence, summary, solution, result (JSON text) and log_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions import results as J, text as T

TTL_SEC = 86_400
SIDE_COLUMNS = ("type", "os", "issue_key", "summary", "solution", "result")


def newest(df: DataFrame, limit: int, ascending: bool = False) -> DataFrame:
    """First rows in stream order; positions compare as numbers, not as text."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("ms", "seq")]
    return df.orderBy(*order).limit(limit)


def alerts_enriched(stream: DataFrame, keyed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stream rows with the values of their keyed row where one exists.

    Summary and solution fall back to the classification result. ``keep`` names further columns of
    the stream that stay.
    """
    side = keyed.select("id", F.struct(*SIDE_COLUMNS).alias("_k"))
    df = stream.join(side, "id", "left")
    for c in SIDE_COLUMNS:
        df = df.withColumn(c, F.when(F.col("_k").isNotNull(), F.col(f"_k.{c}")).otherwise(F.col(c)))
    df = df.withColumn("_r", J.parse_result(F.col("result")))
    return df.select(
        "id",
        "ms",
        "seq",
        *keep,
        *[T.or_empty(F.col(c)).alias(c) for c in ("type", "os", "issue_key")],
        J.filled(F.col("summary"), F.col("_r"), "summary").alias("summary"),
        J.filled(F.col("solution"), F.col("_r"), "recommendation").alias("solution"),
        J.result_text(F.col("_r"), "failure_type").alias("failure_type"),
        F.to_json("_r").alias("result"),
    )


def persist_marks(events: DataFrame) -> DataFrame:
    """One row per persisted alert with the time of its first mark."""
    return events.groupBy("id").agg(F.min("ts").alias("persisted_at"))


def persisted_alerts(events: DataFrame, stream: DataFrame, keyed: DataFrame) -> DataFrame:
    """Keyed rows of persisted alerts; one whose keyed row is gone is rebuilt from the stream."""
    cols = ["id", *SIDE_COLUMNS]
    marks = persist_marks(events)
    stored = keyed.select(*cols).withColumn("rebuilt", F.lit(False))
    lost = stream.join(keyed.select("id"), "id", "left_anti").select(*cols).withColumn("rebuilt", F.lit(True))
    return marks.join(stored.unionByName(lost), "id")


def within_ttl(alerts: DataFrame, as_of_ms: Column, ttl_sec: int = TTL_SEC) -> DataFrame:
    """Alerts no older than the TTL at ``as_of_ms``; persisted ones stay if the rows carry the flag."""
    young = F.col("ms") >= as_of_ms - ttl_sec * 1000
    if "persisted" in alerts.columns:
        young = young | F.col("persisted")
    return alerts.filter(young)


def newest_ms(alerts: DataFrame) -> Column:
    """The newest alert time as a clock, so that reruns over the same rows agree."""
    return alerts.agg(F.max("ms")).scalar()


def list_alerts(
    stream: DataFrame, keyed: DataFrame, persist_events: DataFrame, as_of_ms: Column, limit: int | None = 100, ttl_sec: int = TTL_SEC
) -> DataFrame:
    """Newest alerts within the TTL; free slots go to older persisted ones, newest first.

    Older entries come without summary and solution. All recent alerts are newer than all older
    ones, so one top-k over both gives the listing; without ``limit`` it is whole and in no order.
    Which alerts are listed is decided on (id, ms, seq); only those meet their keyed rows and are parsed.
    """
    marks = persist_marks(persist_events).select("id", F.lit(True).alias("persisted"))
    flagged = stream.select("id", "ms", "seq").join(marks, "id", "left").withColumn("persisted", F.coalesce("persisted", F.lit(False)))
    listed = within_ttl(flagged, as_of_ms, ttl_sec)
    if limit is not None:
        listed = newest(listed, limit)
    rows = stream.join(listed.select("id", "persisted"), "id")
    known = keyed.join(listed.select("id"), "id", "left_semi")
    full = alerts_enriched(rows, known, ("persisted",))
    recent = F.col("ms") >= as_of_ms - ttl_sec * 1000
    shown = full.withColumns({c: F.when(recent, F.col(c)) for c in ("summary", "solution")})
    return shown if limit is None else newest(shown, limit)


def feedback_latest(events: DataFrame) -> DataFrame:
    """Latest verdict per alert; an alert is either correct or incorrect."""
    return events.groupBy("id").agg(F.max_by("feedback", F.struct("ts", "feedback")).alias("feedback"))


def feedback_logs(alerts: DataFrame, feedback_events: DataFrame, logs: DataFrame, issue_logs: DataFrame | None = None) -> DataFrame:
    """Logs behind the alerts marked correct, once per alert that names them.

    An alert lists the first logs of its issue only; ``issue_logs`` (``issues.issue_log_ids``) adds all
    the others of alerts that carry the id of a listed issue.
    """
    good = feedback_latest(feedback_events).filter(F.col("feedback") == "correct")
    named = alerts.join(good.select("id"), "id", "left_semi").select(
        F.col("id").alias("alert_id"), T.normalize_os(F.col("os")).alias("os"), F.explode("log_ids").alias("log_id")
    )
    if issue_logs is not None:
        marked = alerts.join(good.select("id"), "id", "left_semi").select(F.col("id").alias("alert_id"), F.substring_index("id", "-", -1).alias("issue_mark"))
        named = named.unionByName(marked.join(issue_logs, "issue_mark").select("alert_id", "os", "log_id")).distinct()
    return named.join(logs, ["os", "log_id"])


def alert_from_result(candidates: DataFrame, type_: str = "issue") -> DataFrame:
    """Alert columns from candidates (os, issue_key, result JSON text)."""
    df = candidates.withColumn("_f", J.alert_fields(J.parse_result(F.col("result"))))
    return df.select(*candidates.columns, F.lit(type_).alias("type"), "_f.*")


def with_expiry(alerts: DataFrame, ttl_sec: int = TTL_SEC) -> DataFrame:
    """Keyed alert rows as stored: the time after which they are no longer shown."""
    return alerts.withColumn("expires_ms", F.col("ms") + ttl_sec * 1000)


def write_alerts(alerts: DataFrame, path: str, ttl_sec: int = TTL_SEC) -> None:
    """Append alerts to the table at ``path``, one folder per OS."""
    with_expiry(alerts, ttl_sec).write.mode("append").partitionBy("os").parquet(path)
