"""Streams with state: issue sessions, cluster counters, cooldowns.

State is a table in the shared folder that a micro-batch reads as the last finished batch left it, and writes anew
with its own results; the work on it is done by the batch operators. A restart goes on from the last commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.operators.automations import cooldown_fires, with_cooldown_key
from logweave.operators.issues import INACTIVITY_SEC, MAX_LOGS, build_issues, merge_issues
from logweave.streaming.tables import commit, exists, read_committed, read_state, start, write_batch

WATERMARK = "10 minutes"
MARK = "mark"
ISSUE_SCHEMA = (
    "os string, issue_key string, session_us bigint, last_us bigint, n_logs bigint, templated_summary string, "
    "logs array<struct<log_id:bigint,templated:string,raw:string,component:string,pid:string,time:timestamp>>, closed boolean"
)
ROW_SCHEMA = "log_id bigint, ts timestamp, os string, issue_key string, templated string, line string, component string, pid string, late boolean, mark bigint"
CANDIDATES = "os string, cluster_id string"
LAST_SCHEMA = "rule_id string, cooldown_key string, last_ms bigint, cooldown_ms bigint"
FIRE_SCHEMA = "rule_id string, cooldown_key string, provider string, id string, ms bigint, seq bigint"
MATCH_SCHEMA = "rule_id string, cooldown_key string, cooldown_ms bigint, provider string, id string, ms bigint, seq bigint, late boolean"
FIRE_COLUMNS = [c.split()[0] for c in FIRE_SCHEMA.split(", ")]
#: The clock before the first row.
NEVER = -(1 << 62)


def _micros(interval: str) -> int:
    """Microseconds of an interval text such as ``10 minutes``."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}
    number, unit = interval.split()
    return int(float(number) * units[unit.rstrip("s")] * 1_000_000)


def stream_issues(
    logs: DataFrame, out: str, gap_sec: float = INACTIVITY_SEC, max_logs: int = MAX_LOGS, watermark: str = WATERMARK, checkpoint: str | None = None
) -> StreamingQuery:
    """Issues as their inactivity gap runs out on the event-time clock, to the tables ``rows`` and ``issues`` under ``out``.

    A batch makes issues of its own rows with the batch operator and merges them with the open ones, which are
    a table; rows may come in any order. The clock stands ``watermark`` behind the latest row of the batches so far. An issue
    is closed once the clock has passed the end of its gap; no row that is still taken in can belong to it then.
    Rows behind the clock of the batches before their own, or without a time, are marked late in ``rows``, with that clock, and
    are in no issue. The work of a batch follows its rows and the open issues; no row passes through Python.
    """
    gap_us, delay = int(gap_sec * 1_000_000), _micros(watermark)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, facts = read_state(spark, out, "issues", batch_id, ISSUE_SCHEMA)
        mark = facts.get(MARK, NEVER)
        behind = F.coalesce(F.unix_micros("ts") < mark, F.lit(True))
        fields = batch.select("log_id", "ts", "os", "issue_key", "templated", "line", "component", "pid")
        write_batch(fields.withColumns({"late": behind, "mark": F.lit(mark).cast("long")}), f"{out}/rows", batch_id)
        rows = spark.read.schema(ROW_SCHEMA).parquet(f"{out}/rows/batch_id={batch_id}")
        latest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        mark = max(mark, latest - delay) if latest is not None else mark
        fresh = build_issues(rows.filter("not late"), gap_sec=gap_sec, max_logs=max_logs)
        merged = merge_issues(before.filter("not closed").drop("closed").unionByName(fresh), gap_sec=gap_sec, max_logs=max_logs)
        closed = F.ceil((F.col("last_us") + gap_us) / 1000) < mark // 1000
        write_batch(merged.withColumn("closed", closed), f"{out}/issues", batch_id)
        commit(spark, out, batch_id, mark=mark)

    return start(logs, each, checkpoint)


def closed_issues(spark: SparkSession, out: str) -> DataFrame:
    """The issues that ``stream_issues`` has closed so far, their logs as JSON text."""
    return read_committed(spark, out, "issues", ISSUE_SCHEMA).filter("closed").drop("closed").withColumn("logs", F.to_json("logs"))


def taken_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that went into issues."""
    return read_committed(spark, out, "rows", ROW_SCHEMA).filter("not late").drop("late", "mark")


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """The rows that came behind the clock, with the clock (microseconds) of that moment."""
    return read_committed(spark, out, "rows", ROW_SCHEMA).filter("late").drop("late")


def stream_cluster_candidates(assigned: DataFrame, out: str, threshold: int = 20, checkpoint: str | None = None) -> StreamingQuery:
    """Each (os, cluster_id) once, in the micro-batch in which its log count reaches the threshold, to the table ``candidates`` under ``out``.

    Counts are Spark's own streaming aggregate, partial before the shuffle; a batch gets those that have changed and
    writes the ones over the threshold that no earlier batch has written. A replayed batch writes the same again.
    """
    counts = assigned.groupBy("os", "cluster_id").agg(F.count(F.lit(1)).alias("n"))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reached = batch.filter(F.col("n") >= threshold).select("os", "cluster_id")
        if exists(spark, f"{out}/candidates"):
            written = spark.read.schema(f"{CANDIDATES}, batch_id bigint").parquet(f"{out}/candidates").filter(F.col("batch_id") < batch_id)
            same = F.col("os").eqNullSafe(F.col("_os")) & F.col("cluster_id").eqNullSafe(F.col("_cluster"))
            reached = reached.join(written.select(F.col("os").alias("_os"), F.col("cluster_id").alias("_cluster")), same, "left_anti")
        write_batch(reached, f"{out}/candidates", batch_id)
        commit(spark, out, batch_id)

    return start(counts, each, checkpoint, "update")


def stream_candidates(spark: SparkSession, out: str) -> DataFrame:
    """The candidates written so far."""
    return read_committed(spark, out, "candidates", CANDIDATES)


def stream_fires(matches: DataFrame, out: str, watermark: str = WATERMARK, checkpoint: str | None = None) -> StreamingQuery:
    """Matches that fire under their cooldown, to the tables ``matches``, ``fires`` (rule_id, cooldown_key, provider, id, ms, seq) and ``last`` under ``out``.

    A batch decides its own rows with the batch operator; the last fire of a (rule, key) is kept in a table until
    its cooldown has run out on the event-time clock, from when on the next match fires anyway. Rows of a batch
    are taken in the order of (ms, seq); matches behind the clock of the batches before are marked late and do not fire.
    """
    delay = _micros(watermark) // 1000

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, facts = read_state(spark, out, "last", batch_id, LAST_SCHEMA)
        mark = facts.get(MARK, NEVER)
        keyed = with_cooldown_key(batch).filter(F.col("cooldown_ms") > 0).withColumn("late", F.coalesce(F.col("ms") < mark, F.lit(True)))
        write_batch(keyed.select(*[f.split()[0] for f in MATCH_SCHEMA.split(", ")]), f"{out}/matches", batch_id)
        rows = spark.read.schema(MATCH_SCHEMA).parquet(f"{out}/matches/batch_id={batch_id}")
        latest = rows.agg(F.max("ms")).first()[0]
        mark = max(mark, latest - delay) if latest is not None else mark
        write_batch(cooldown_fires(rows.filter("not late"), last=last).select(*FIRE_COLUMNS, "cooldown_ms"), f"{out}/fires", batch_id)
        fired = spark.read.schema(f"{FIRE_SCHEMA}, cooldown_ms bigint").parquet(f"{out}/fires/batch_id={batch_id}")
        now = last.unionByName(fired.select("rule_id", "cooldown_key", F.col("ms").alias("last_ms"), "cooldown_ms")).groupBy("rule_id", "cooldown_key").agg(
            F.max("last_ms").alias("last_ms"), F.max_by("cooldown_ms", "last_ms").alias("cooldown_ms")
        )
        write_batch(now.filter(F.col("last_ms") + F.col("cooldown_ms") > mark), f"{out}/last", batch_id)
        commit(spark, out, batch_id, mark=mark)

    return start(matches, each, checkpoint)


def fires(spark: SparkSession, out: str) -> DataFrame:
    """The fires written so far."""
    return read_committed(spark, out, "fires", FIRE_SCHEMA)


def late_matches(spark: SparkSession, out: str) -> DataFrame:
    """The matches that came behind the clock."""
    return read_committed(spark, out, "matches", MATCH_SCHEMA).filter("late").drop("late")
