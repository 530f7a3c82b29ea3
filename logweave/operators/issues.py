"""Grouping log lines into issues by an inactivity gap.

One key (all unparsed lines of an OS, say) may hold a third of the data, so nothing here sorts a
whole key. Rows are windowed per (key, time bucket); only one edge row per bucket crosses bucket
borders, and an issue keeps at most its first logs per bucket before the buckets are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.session import checkpointed

ISSUE_KEYS = ("os", "issue_key")
INACTIVITY_SEC = 120
MAX_LOGS = 50
#: Rows of a key are sorted within such a stretch of time; no result depends on it.
BUCKET_SEC = 60


def _bucketed(df: DataFrame, keys: Sequence[str], gap_us: int, bucket_us: int, tie: str) -> DataFrame:
    """Rows with their bucket, the start of the run they belong to (null: carried in) and rank in it."""
    df = df.withColumn("_us", F.unix_micros("ts")).withColumn("_bucket", F.expr(f"(_us - pmod(_us, {bucket_us})) div {bucket_us}"))
    w = Window.partitionBy(*keys, "_bucket").orderBy("_us", tie)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prev = F.lag("_us").over(w)
    df = df.withColumns(
        {
            "_begins": F.when(F.col("_us") - prev >= gap_us, F.col("_us")),
            "_row": F.row_number().over(w),
        }
    )
    first_row = F.max(F.when(F.col("_begins").isNotNull(), F.col("_row"))).over(so_far)
    return df.withColumns(
        {
            "_run": F.max("_begins").over(so_far),
            "_rank": F.col("_row") - F.coalesce(first_row, F.lit(1)) + 1,
        }
    )


def _edges(rows: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """Per (key, bucket): the session that its first row belongs to."""
    edges = rows.groupBy(*keys, "_bucket").agg(
        F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.max("_begins").alias("_last_run")
    )
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = F.lag("_last").over(w)
    opens = F.when(before.isNull() | (F.col("_first") - before >= gap_us), F.col("_first"))
    edges = edges.withColumn("_opens", opens).withColumn(
        "_leaves", F.coalesce("_last_run", "_opens")
    )
    carried = F.last("_leaves", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return edges.select(*keys, "_bucket", F.coalesce("_opens", carried).alias("_enter"))




def _with_sessions(
    df: DataFrame, keys: Sequence[str], gap_sec: float, bucket_sec: int, tie: str
) -> DataFrame:
    gap_us, bucket_us = int(gap_sec * 1_000_000), int(bucket_sec * 1_000_000)
    rows = _bucketed(df, keys, gap_us, bucket_us, tie)
    edges = _edges(rows, keys, gap_us)
    edges = edges.select(*[F.col(c).alias(f"_e_{c}") for c in edges.columns])
    cond = F.col("_bucket") == F.col("_e__bucket")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    joined = rows.join(edges, cond)
    return joined.withColumn("session_us", F.coalesce("_run", "_e__enter")).drop(*edges.columns)


def issue_sessions(
    df: DataFrame,
    keys: Sequence[str] = ISSUE_KEYS,
    gap_sec: float = INACTIVITY_SEC,
    bucket_sec: int = BUCKET_SEC,
    tie: str = "log_id",
) -> DataFrame:
    """Add ``session_us``: the first event time (microseconds) of the row's session.

    A session ends when the next row of its key comes ``gap_sec`` or more later.
    """
    out = _with_sessions(df, keys, gap_sec, bucket_sec, tie)
    return out.select(*df.columns, "session_us")


def build_issues(
    logs: DataFrame,
    keys: Sequence[str] = ISSUE_KEYS,
    gap_sec: float = INACTIVITY_SEC,
    max_logs: int = MAX_LOGS,
    bucket_sec: int = BUCKET_SEC,
    with_logs: bool = True,
) -> DataFrame:
    """Issues with their first ``max_logs`` logs in (ts, log_id) order.

    Without ``with_logs`` the column ``logs`` is left out, and raw lines, components and pids are not moved: the
    summary has the masked texts of the same logs.

    Rows are shuffled once, by (key, bucket). What leaves a bucket is one row per run with its
    first logs. Only the first and the last run of a bucket can belong to a longer session, so
    only they meet in the window of their key; a run inside a bucket is a session of its own and
    gets its own lane.
    """
    gap_us, bucket_us = int(gap_sec * 1_000_000), int(bucket_sec * 1_000_000)
    rows = _bucketed(logs, keys, gap_us, bucket_us, "log_id")
    log = F.struct("_us", "log_id", "templated", *([F.col("line").alias("raw"), "component", "pid"] if with_logs else []))
    runs = rows.groupBy(*keys, "_bucket", "_run").agg(
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.when(F.col("_rank") <= max_logs, log)).alias("_logs"),
    )
    last_run = F.max("_run").over(Window.partitionBy(*keys, "_bucket"))
    runs = runs.withColumn("_lane", F.when(F.col("_run") < last_run, F.col("_run")))

    w = Window.partitionBy(*keys, "_lane").orderBy("_first")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.lag("_last").over(w)
    begins = F.col("_run").isNotNull() | before.isNull() | (F.col("_first") - before >= gap_us)
    runs = runs.withColumns(
        {"_begins": begins, "_earlier": F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    at_begin = F.max(F.when(F.col("_begins"), F.col("_earlier"))).over(so_far)
    runs = runs.withColumns(
        {"session_us": F.max(F.when(F.col("_begins"), F.col("_first"))).over(so_far), "_earlier": F.col("_earlier") - at_begin}
    )
    merged = runs.groupBy(*keys, "_lane", "session_us").agg(
        F.sum("_n").alias("n_logs"),
        F.max("_last").alias("last_us"),
        F.collect_list(F.when(F.col("_earlier") < max_logs, F.col("_logs"))).alias("_logs"),
    )
    merged = merged.withColumn("_logs", F.slice(F.array_sort(F.flatten("_logs")), 1, max_logs))
    logs = F.transform(
        "_logs",
        lambda x: F.struct(
            x["log_id"].alias("log_id"),
            x["templated"].alias("templated"),
            x["raw"].alias("raw"),
            x["component"].alias("component"),
            x["pid"].alias("pid"),
            F.timestamp_micros(x["_us"]).alias("time"),
        ),
    )
    return merged.select(
        *keys,
        "session_us",
        "last_us",
        "n_logs",
        F.array_join(F.col("_logs")["templated"], " \n").alias("templated_summary"),
        *([logs.alias("logs")] if with_logs else []),
    )


def merge_issues(parts: DataFrame, keys: Sequence[str] = ISSUE_KEYS, gap_sec: float = INACTIVITY_SEC, max_logs: int = MAX_LOGS) -> DataFrame:
    """Issues as ``build_issues`` makes them from issues of parts of the logs, in whatever order the parts came.

    Parts of one issue may overlap or be apart by less than the gap. Only their bounds are sorted by key; the
    logs are attached afterwards, the first ``max_logs`` of each part.
    """
    gap_us = int(gap_sec * 1_000_000)
    numbered = checkpointed(parts.withColumn("_part", F.monotonically_increasing_id()))
    w = Window.partitionBy(*keys).orderBy("session_us", "last_us", "_part")
    reach = F.max("last_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("session_us") - reach >= gap_us), F.col("session_us"))
    slim = numbered.select(*keys, "session_us", "last_us", "_part").withColumn("_begins", begins)
    placed = slim.select("_part", F.last("_begins", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_start"))
    merged = numbered.drop("session_us", "templated_summary").join(placed, "_part").groupBy(*keys, F.col("_start").alias("session_us")).agg(
        F.max("last_us").alias("last_us"), F.sum("n_logs").alias("n_logs"), F.flatten(F.collect_list("logs")).alias("_logs")
    )
    in_order = F.array_sort(F.transform("_logs", lambda x: F.struct(x["time"].alias("time"), x["log_id"].alias("log_id"), x.alias("log"))))
    kept = merged.withColumn("logs", F.slice(in_order, 1, max_logs)["log"])
    return kept.select(*keys, "session_us", "last_us", "n_logs", F.array_join(F.col("logs")["templated"], " \n").alias("templated_summary"), "logs")


def _issue_mark(os: Column, issue_key: Column, session_us: Column) -> Column:
    """What the id of a listed issue ends in."""
    return F.substring(F.sha1(F.concat_ws("|", os, issue_key, session_us)), 1, 12)


def issue_log_ids(lines: DataFrame, gap_sec: float = INACTIVITY_SEC) -> DataFrame:
    """(issue_mark, os, log_id) of all logs of all issues, not only the first ones that an issue keeps."""
    rows = issue_sessions(lines.select("os", "issue_key", "ts", "log_id"), gap_sec=gap_sec)
    return rows.select(_issue_mark(F.col("os"), F.col("issue_key"), F.col("session_us")).alias("issue_mark"), "os", "log_id")


def issue_entries(issues: DataFrame, gap_sec: float = INACTIVITY_SEC) -> DataFrame:
    """Issues as listed: published when the gap has run out, logs (where the issues have them) as JSON text.

    The id is the closing millisecond with a hash of (os, key, start) behind it, so reruns agree.
    """
    ms = F.floor((F.col("last_us") + int(gap_sec * 1_000_000)) / 1000).cast("bigint")
    return issues.select(
        ms.alias("ms"),
        F.concat_ws("-", ms, _issue_mark(F.col("os"), F.col("issue_key"), F.col("session_us"))).alias("id"),
        "os",
        "issue_key",
        "templated_summary",
        *([F.to_json("logs").alias("logs")] if "logs" in issues.columns else []),
    )


def list_incidents(entries: DataFrame, limit: int = 100) -> DataFrame:
    """Newest issues first, their logs read back as an array (unreadable JSON: none)."""
    schema = "array<struct<log_id:bigint,templated:string,raw:string,component:string,pid:string,time:string>>"
    newest = entries.orderBy(F.col("ms").desc(), F.col("id").desc()).limit(limit)
    empty = F.expr(f"CAST(array() AS {schema})")
    return newest.select(
        "id",
        "os",
        "issue_key",
        "templated_summary",
        F.coalesce(F.from_json("logs", schema), empty).alias("logs"),
        F.col("ms").alias("time_ms"),
    )


def cluster_counts(assigned: DataFrame) -> DataFrame:
    """Logs per (os, cluster)."""
    return assigned.groupBy("os", "cluster_id").agg(F.count(F.lit(1)).alias("n_logs"))


def cluster_candidates(assigned: DataFrame, threshold: int = 20) -> DataFrame:
    """Each cluster once, at the log with which its count reaches the threshold.

    The rank filter is applied before the shuffle too, so a hot cluster sends few rows.
    """
    w = Window.partitionBy("os", "cluster_id").orderBy("ts", "log_id")
    ranked = assigned.select("os", "cluster_id", "ts", "log_id").withColumn("_n", F.row_number().over(w))
    return ranked.filter(F.col("_n") == threshold).drop("_n")
