"""Streaming queries: the given tables read as file streams, run until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.operators import automations as U, clustering as C, issues as I, logs as L
from logweave.plans import alert_queries as AQ, fixtures as X, line_queries as LQ, metric_queries as MQ, oracle as O, vector_queries as VQ
from logweave.plans.registry import query
from logweave.session import checkpointed, fresh_path
from logweave.sources.tail import follow_text_logs
from logweave.streaming import state as S, tables as B


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.event_lines(X.table_stream(spark, sf_dir, "events"))


CLOSED = """, closed AS (SELECT i.*, ((SELECT epoch_us(max(ts)) FROM events) - 600000000) // 1000 AS mark FROM issues i)"""


@query(
    "stream_issues",
    f"""WITH {O.ISSUES}{CLOSED} SELECT os, issue_key, session_us, last_us, n_logs, templated_summary FROM closed
    WHERE CAST(ceil((last_us + 120000000) / 1000.0) AS BIGINT) < mark""",
)
def stream_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues closed by the clock; the last ones stay open. Five parts come one after the other, rows near their borders out of order."""
    return S.closed_issues(spark, _run_issue_parts(spark, sf_dir, MINUTES_OFF)).drop("logs")


#: The part that a row lands in: by time in stretches of six days, moved by up to four minutes.
MINUTES_OFF = "least(greatest((unix_micros(ts) + (event_id % 9 - 4) * 60000000 - 1704067200000000) div 518400000000, 0), 4)"
#: The same, but every fiftieth row comes a part later than it should.
PARTS_LATE = f"least({MINUTES_OFF} + if(event_id % 50 = 0, 1, 0), 4)"


def _run_issue_parts(spark: SparkSession, sf_dir: str, part: str) -> str:
    out, landed, checkpoint = fresh_path(spark, "issues"), fresh_path(spark, "landed"), fresh_path(spark, "stream-checkpoint")
    events = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def run(stream: DataFrame) -> None:
        S.stream_issues(L.parse_and_template(X.event_lines(stream)), out, checkpoint=checkpoint).awaitTermination()

    X.land_parts(X.parted(events, F.expr(part), 5), landed, run)
    return out


@query(
    "stream_late_rows",
    """WITH p AS (SELECT event_id, epoch_us(ts) AS us,
      least(least(greatest((epoch_us(ts) + (event_id % 9 - 4) * 60000000 - 1704067200000000) // 518400000000, 0), 4) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END, 4) AS part FROM events),
    l AS (SELECT part, max(us) AS latest FROM p GROUP BY part),
    m AS (SELECT p.event_id, p.us, max(l.latest) - 600000000 AS mark FROM p LEFT JOIN l ON l.part < p.part GROUP BY ALL)
    SELECT event_id AS log_id, coalesce(us < mark, false) AS late FROM m""",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row once: taken into an issue, or late and set aside."""
    out = _run_issue_parts(spark, sf_dir, PARTS_LATE)
    late, taken = S.late_rows(spark, out), S.taken_rows(spark, out)
    return late.select("log_id", F.lit(True).alias("late")).unionByName(taken.select("log_id", F.lit(False).alias("late")))


@query(
    "stream_cluster_candidates",
    f"{LQ.ASSIGNED_SQL} SELECT os, cluster_id FROM assigned GROUP BY 1, 2 HAVING count(*) >= 20",
)
def stream_cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters at twenty logs, counted over five parts."""
    out, landed, checkpoint = fresh_path(spark, "candidates"), fresh_path(spark, "landed"), fresh_path(spark, "stream-checkpoint")

    def run(stream: DataFrame) -> None:
        lines = L.parse_and_template(X.event_lines(stream))
        S.stream_cluster_candidates(lines.withColumn("cluster_id", F.concat(F.lit("c"), F.col("user_id") % 20)), out, checkpoint=checkpoint).awaitTermination()

    events = X.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    X.land_parts(X.parted(events, F.pmod("event_id", F.lit(5)), 5), landed, run)
    return S.stream_candidates(spark, out)


@query(
    "stream_automations",
    f"WITH RECURSIVE {O.ALERTS}, {AQ.RULES_SQL} SELECT rule_id, issue_key AS cooldown_key, provider, id, ms, seq FROM fired",
)
def stream_automations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automations that fire, over five parts in the order of time; a day's orders are in one part."""
    out, landed, checkpoint = fresh_path(spark, "fires"), fresh_path(spark, "landed"), fresh_path(spark, "stream-checkpoint")

    def run(stream: DataFrame) -> None:
        S.stream_fires(U.match_automations(X.order_alerts(stream), X.RULES), out, checkpoint=checkpoint).awaitTermination()

    part = F.expr("least(greatest((year(o_orderdate) - 1995) div 2, 0), 4)")
    X.land_parts(X.parted(X.table(spark, sf_dir, "orders"), part, 5), landed, run)
    return S.fires(spark, out)


@query(
    "stream_consume",
    f"""WITH {O.PARSED}, s AS (SELECT *, {O.labels("templated || ' ' || line")} AS ev FROM parsed)
    SELECT log_id, os, component, pid, templated, coalesce(ev[1], 'unknown') AS label FROM s""",
)
def stream_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log table that the consumer writes from the line stream."""
    out = fresh_path(spark, "consume")
    lines = line_stream(spark, sf_dir).select("log_id", "ts", "source", "line", "source_id")
    B.consume(lines, X.sources(spark, sf_dir), VQ.text_prototypes(VQ.templated_logs(spark, sf_dir)[1]), out).awaitTermination()
    return B.read_table(spark, f"{out}/logs").select("log_id", "os", "component", "pid", "templated", "label")


@query("stream_consume_vectors", f"WITH {O.PARSED} SELECT log_id, os, templated AS document FROM parsed WHERE templated <> ''")
def stream_consume_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector rows that the consumer writes for retrieval."""
    out = fresh_path(spark, "consume")
    lines = line_stream(spark, sf_dir).select("log_id", "ts", "source", "line", "source_id")
    B.consume(lines, X.sources(spark, sf_dir), X.prototypes(spark, sf_dir), out).awaitTermination()
    return B.read_table(spark, f"{out}/vectors").select("log_id", "os", "document")


@query("stream_consume_exports", f"WITH {O.SNMP} SELECT log_id, name, round(scaled, 6) AS value FROM snmp_points")
def stream_consume_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points that the consumer exports from device readings."""
    out, landed = fresh_path(spark, "consume"), fresh_path(spark, "landed")
    MQ.snmp_lines(spark, sf_dir).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    B.consume(stream, X.sources(spark, sf_dir), X.prototypes(spark, sf_dir), out).awaitTermination()
    return B.read_table(spark, f"{out}/exported").select("log_id", "name", F.round("value", 6).alias("value"))


@query(
    "stream_consume_metrics",
    f"WITH {O.SNMP} SELECT log_id, name, round(scaled, 6) AS value FROM snmp_points",
)
def stream_consume_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric table that the consumer writes when device readings are on the stream."""
    out, landed = fresh_path(spark, "consume"), fresh_path(spark, "landed")
    MQ.snmp_lines(spark, sf_dir).write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    B.consume(stream, X.sources(spark, sf_dir), X.prototypes(spark, sf_dir), out).awaitTermination()
    rows = B.read_table(spark, f"{out}/metrics")
    return rows.select("log_id", "name", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("stream_assign", f"WITH RECURSIVE {O.TEXT_CLUSTERS} SELECT log_id, os, cluster_id FROM parsed LEFT JOIN text_clusters USING (os, templated)")
def stream_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster ids given to streamed lines while the prototype table grows."""
    table, out = fresh_path(spark, "prototypes"), fresh_path(spark, "assigned")
    B.write_batch(VQ.text_prototypes(VQ.templated_logs(spark, sf_dir)[1]), table, -1)
    lines = L.parse_and_template(line_stream(spark, sf_dir)).select("log_id", "ts", "os", "templated")
    B.assign(lines, table, out).awaitTermination()
    return B.read_table(spark, out).select("log_id", "os", "cluster_id")


@query(
    "stream_rejects",
    f"""WITH {O.LINES} SELECT CASE WHEN log_id % 10 = 4 THEN 'not json' WHEN log_id % 10 = 5 THEN 'missing ts'
      WHEN log_id % 10 = 6 THEN 'missing log_id,line' ELSE '' END AS reason, count(*) AS n FROM log_lines GROUP BY 1""",
)
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of all lines, three kinds of them broken; accepted ones count under no reason."""
    k = F.col("log_id") % 10
    whole = F.to_json(F.struct("log_id", "ts", "source", "line"))
    broken = (
        F.when(k == 4, F.concat(F.lit("{"), whole)).when(k == 5, F.to_json(F.struct("log_id", "source", "line")))
        .when(k == 6, F.to_json(F.struct("ts", "source"))).otherwise(whole)
    )
    raw = line_stream(spark, sf_dir).select(broken.alias("value"))
    out = fresh_path(spark, "envelopes")

    B.consume_envelopes(raw, X.sources(spark, sf_dir), X.prototypes(spark, sf_dir), out).awaitTermination()
    rejects = B.read_table(spark, f"{out}/rejects").select("reason")
    lines = B.read_table(spark, f"{out}/logs").select(F.lit("").alias("reason"))
    return rejects.unionByName(lines).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_enrich_issues",
    f"""WITH {O.ISSUES} SELECT os, issue_key, session_us AS seq, 'issue' AS type, log_ids FROM issues""",
)
def stream_enrich_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues on a stream to the alert table: one alert per issue, naming its logs."""
    logs, texts = VQ.templated_logs(spark, sf_dir)
    landed, out = fresh_path(spark, "issues"), fresh_path(spark, "alerts")
    issues = I.build_issues(logs).withColumns({"id": F.concat_ws("|", "os", "issue_key", "session_us"), "ms": F.floor(F.col("last_us") / 1000), "seq": F.col("session_us")})
    issues.write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).parquet(landed)
    items = logs.select("os", "log_id", F.col("templated").alias("document"))
    templates = VQ.text_templates(texts)
    B.enrich_issue_stream(stream, templates, items, out, texts=templates).awaitTermination()
    alerts = B.read_table(spark, out)
    return alerts.select("os", "issue_key", "seq", "type", F.array_join(F.col("log_ids").cast("array<string>"), ",").alias("log_ids"))


@query("stream_enrich_clusters", f"WITH RECURSIVE {O.CLUSTER_RESULTS} SELECT os, cluster_id, 'cluster' AS type, failure_type FROM cluster_results")
def stream_enrich_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster candidates on a stream to alerts."""
    logs, texts = VQ.templated_logs(spark, sf_dir)
    protos = VQ.text_prototypes(texts)
    assigned, created = C.assign_clusters(texts, protos)
    placed = checkpointed(C.logs_with_cluster(logs.select("log_id", "ts", "os", "templated"), assigned))
    landed = fresh_path(spark, "cluster-candidates")
    I.cluster_candidates(placed).select("os", "cluster_id", "ts").write.parquet(landed)
    stream = spark.readStream.schema("os string, cluster_id string, ts timestamp").parquet(landed)
    items = placed.select("os", "cluster_id", "log_id", F.col("templated").alias("document"))
    out, relabelled = fresh_path(spark, "cluster-alerts"), fresh_path(spark, "relabelled")
    known = checkpointed(protos.unionByName(created))
    templates = VQ.text_templates(texts)
    B.enrich_cluster_stream(stream, known, templates, items, out, relabelled, texts=templates).awaitTermination()
    return B.read_table(spark, out).select("os", "cluster_id", "type", "failure_type")


@query(
    "stream_totals",
    f"""WITH {MQ.ALL_LINES}, t AS (SELECT CASE origin WHEN 'snmp' THEN 0 ELSE 1 END AS batch, name, value, time_unix_nano FROM ({MQ.ALL_ROWS}) WHERE origin <> 'agent')
    SELECT batch::BIGINT AS batch, count(value) AS exported, max(CASE WHEN value IS NOT NULL THEN time_unix_nano END) AS exported_nano,
      count(*) FILTER (WHERE starts_with(name, 'redfish.')) AS redfish, max(CASE WHEN starts_with(name, 'redfish.') THEN time_unix_nano END) AS redfish_nano FROM t GROUP BY 1""",
)
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of export and Redfish of two batches: device readings, then sensor payloads."""
    out, landed, checkpoint = fresh_path(spark, "consume"), fresh_path(spark, "landed"), fresh_path(spark, "stream-checkpoint")

    def run(stream: DataFrame) -> None:
        B.consume(stream, X.sources(spark, sf_dir), X.prototypes(spark, sf_dir), out, checkpoint=checkpoint).awaitTermination()

    X.land_parts([MQ.snmp_lines(spark, sf_dir), MQ.sensor_lines(spark, sf_dir)], landed, run)
    return B.batch_totals(spark, out)


@query("stream_follow", f"WITH {O.LINES} SELECT trim(line) AS line, count(*) AS n FROM log_lines GROUP BY 1")
def stream_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a growing folder, followed by bytes over two runs of one stream."""
    landed, out, checkpoint = fresh_path(spark, "text"), fresh_path(spark, "followed"), fresh_path(spark, "stream-checkpoint")
    lines = X.log_lines(spark, sf_dir)
    for part in range(2):
        lines.filter(F.pmod("log_id", F.lit(2)) == part).select("line").write.mode("append").text(landed)
        followed = B.run_to_table(follow_text_logs(spark, landed, "part-*"), out, checkpoint)
    return followed.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
