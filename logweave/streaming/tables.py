"""Streams that write tables batch by batch.

A micro-batch writes its own folder ``batch_id=<n>`` and overwrites it when it is replayed after a
failure, so nothing is counted twice. Where a batch writes several tables, or state that the next one starts from, it
names itself in a log of commits when all are written; readers take the batches that are named there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logweave.operators import alerts as A, clustering as C, enrichment as N, logs as L, metrics as M
from logweave.operators.embedding import Embedder, embed_distinct
from logweave.operators.knn import nearest
from logweave.operators.upsert import upsert_latest
from logweave.session import checkpointed, fresh_path, spread

LINE_SCHEMA = "log_id bigint, ts timestamp, source string, line string, source_id bigint"
JUDGED_SCHEMA = f"e struct<{LINE_SCHEMA}>, value string, reason string"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All batches written so far."""
    return spark.read.parquet(path).drop("batch_id")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def commit(spark: SparkSession, out: str, batch_id: int, **facts: int | None) -> None:
    """Name a batch as finished, with whole numbers to remember: the last thing that a batch writes under ``out``.

    One row in one file, which is there or not; a replayed batch writes it again.
    """
    fields = ", ".join(["batch bigint", *(f"{k} bigint" for k in facts)])
    spark.createDataFrame([(batch_id, *facts.values())], fields).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/batch_id={batch_id}")


def last_commit(spark: SparkSession, out: str, before: int | None = None) -> dict[str, int]:
    """The facts of the last finished batch (below ``before``); empty if there is none."""
    if not exists(spark, f"{out}/commits"):
        return {}
    rows = spark.read.parquet(f"{out}/commits").drop("batch_id")
    last = (rows if before is None else rows.filter(F.col("batch") < before)).orderBy(F.col("batch").desc()).limit(1).collect()
    return last[0].asDict() if last else {}


def read_committed(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """The rows of table ``name`` under ``out`` from finished batches alone; a half-written batch is not read."""
    if not exists(spark, f"{out}/commits") or not exists(spark, f"{out}/{name}"):
        return spark.createDataFrame([], schema)
    # a number for each batch, as the listing of the table has: as literals they keep the files of other batches from being opened
    done = [r.batch for r in spark.read.parquet(f"{out}/commits").select("batch").collect()]
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{out}/{name}")
    return rows.filter(F.col("batch_id").isin(done)).drop("batch_id")


def read_state(spark: SparkSession, out: str, name: str, batch_id: int, schema: str) -> tuple[DataFrame, dict[str, int]]:
    """What batch ``batch_id`` starts from: table ``name`` as the last finished batch before it left it, and its facts."""
    facts = last_commit(spark, out, batch_id)
    if not facts:
        return spark.createDataFrame([], schema), facts
    return spark.read.schema(schema).parquet(f"{out}/{name}/batch_id={facts['batch']}"), facts


def start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, mode: str = "append") -> StreamingQuery:
    """Run ``each`` over everything available, then stop."""
    checkpoint = checkpoint or fresh_path(df.sparkSession, "stream-checkpoint")
    return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Append a stream's rows to a table and return what it holds at the end."""
    checkpoint = checkpoint or fresh_path(df.sparkSession, "stream-checkpoint")
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_envelopes(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) from JSON envelopes of one line each.

    An envelope that is no JSON object, or lacks log_id, ts or line, goes to the rejects with the
    reason and its text as it came.
    """
    return split_envelopes(judge_envelopes(raw, value))


def judge_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Each envelope read: the fields ``e`` of its line and an empty reason, or the reason and its text ``value``."""
    parsed = raw.select(F.col(value).alias("value"), F.from_json(value, LINE_SCHEMA).alias("e"))
    missing = F.concat_ws(",", *[F.when(F.col(f"e.{c}").isNull(), c) for c in ("log_id", "ts", "line")])
    reason = F.when(F.try_parse_json("value").isNull(), "not json").when(missing != "", F.concat(F.lit("missing "), missing)).otherwise("")
    judged = parsed.withColumn("reason", reason)
    taken = F.col("reason") == ""
    return judged.select(F.when(taken, F.col("e")).alias("e"), F.when(~taken, F.col("value")).alias("value"), "reason")


def split_envelopes(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged.filter("reason = ''").select("e.*"), judged.filter("reason <> ''").select("value", "reason")


def consume(
    lines: DataFrame,
    sources: DataFrame,
    prototypes: DataFrame,
    out: str,
    threshold: float = L.PROTOTYPE_THRESHOLD,
    embedder: Embedder | None = None,
    export_limit: int | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Lines to the tables ``metrics``, ``exported``, ``logs``, ``vectors`` and ``candidates`` under ``out``.

    Each distinct masked text of a batch is embedded and looked up once; ``vectors`` has a row for each
    line with text, the rows that retrieval reads. ``export_limit`` counts the points of one line. The commit of a batch
    holds its totals: points exported and Redfish points normalised, with their latest times.
    """
    each = lambda batch, batch_id: _consume_batch(batch, batch_id, sources, prototypes, out, threshold, embedder, export_limit)
    return start(lines, each, checkpoint)


def batch_totals(spark: SparkSession, out: str) -> DataFrame:
    """One row for each finished batch of a consumer: batch, exported, exported_nano, redfish, redfish_nano (null times: no point)."""
    return spark.read.parquet(f"{out}/commits").select("batch", "exported", "exported_nano", "redfish", "redfish_nano")


def consume_envelopes(raw: DataFrame, sources: DataFrame, prototypes: DataFrame, out: str, value: str = "value") -> StreamingQuery:
    """The same from JSON envelopes; those that hold no line go to the table ``rejects`` with the reason."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # the envelopes are read once: what they hold is written to the batch's own folder, and both sides come from there
        write_batch(judge_envelopes(batch, value), f"{out}/envelopes", batch_id)
        lines, rejects = split_envelopes(batch.sparkSession.read.schema(JUDGED_SCHEMA).parquet(f"{out}/envelopes/batch_id={batch_id}"))
        write_batch(rejects, f"{out}/rejects", batch_id)
        _consume_batch(lines, batch_id, sources, prototypes, out)

    return start(raw, each)


def _consume_batch(
    batch: DataFrame, batch_id: int, sources: DataFrame, prototypes: DataFrame, out: str,
    threshold: float = L.PROTOTYPE_THRESHOLD, embedder: Embedder | None = None, export_limit: int | None = None,
) -> None:
    points = M.with_points(spread(batch), sources).persist()
    try:
        metrics, rest = M.split_metrics_logs(points)
        # totals are gathered while the tables are written, without another pass
        time = F.col("time_unix_nano").cast("bigint")
        is_redfish = F.col("name").startswith("redfish.")
        normalized, exported = Observation(f"normalized-{batch_id}"), Observation(f"exported-{batch_id}")
        seen = metrics.observe(normalized, F.count_if(is_redfish).alias("n"), F.max(F.when(is_redfish, time)).alias("last"))
        write_batch(M.metric_stream_rows(seen), f"{out}/metrics", batch_id)
        sent = M.metric_export_rows(metrics, export_limit).observe(exported, F.count(F.lit(1)).alias("n"), F.max(time).alias("last"))
        write_batch(sent, f"{out}/exported", batch_id)
        write_batch(L.with_signals(L.parse_and_template(rest)), f"{out}/logs", batch_id)
    finally:
        points.unpersist()
    logs = batch.sparkSession.read.parquet(f"{out}/logs/batch_id={batch_id}")
    texts = checkpointed(embed_distinct(logs.filter("templated <> ''"), ["os"], "templated", embedder))
    vectors = logs.join(texts, ["os", "templated"]).select("os", "log_id", F.col("templated").alias("document"), "embedding")
    write_batch(vectors, f"{out}/vectors", batch_id)
    write_batch(L.line_candidates(_with_nearest(logs, texts, prototypes), threshold), f"{out}/candidates", batch_id)
    found = {"exported": exported.get, "redfish": normalized.get}
    facts = {k: v for name, o in found.items() for k, v in ((name, o.get("n", 0)), (f"{name}_nano", o.get("last")))}
    commit(batch.sparkSession, out, batch_id, **facts)


def with_nearest(logs: DataFrame, prototypes: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Add distance and nearest_label of the nearest prototype, searched once per distinct text.

    Empty text has none.
    """
    return _with_nearest(logs, embed_distinct(logs.filter("templated <> ''"), ["os"], "templated", embedder), prototypes)


def _with_nearest(logs: DataFrame, texts: DataFrame, prototypes: DataFrame) -> DataFrame:
    texts = texts.withColumn("text_id", C.text_id(F.col("os"), F.col("templated")))
    items = prototypes.select("os", "cluster_id", F.col("label").alias("nearest_label"), F.col("centroid").alias("embedding"))
    hits = nearest(texts, items, 1, "text_id", "cluster_id").join(items.drop("embedding"), ["os", "cluster_id"])
    found = texts.drop("embedding").join(hits.select("text_id", "distance", "nearest_label"), "text_id").drop("text_id")
    return logs.join(found, ["os", "templated"], "left")


def assign(
    logs: DataFrame, prototypes_path: str, out: str, threshold: float = C.ONLINE_THRESHOLD, embedder: Embedder | None = None
) -> StreamingQuery:
    """Cluster ids for streamed logs (os, templated, log_id); new prototypes join the table.

    Every batch sees the prototypes of the batches before it. A replayed batch ignores the
    prototypes it had written itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the first batch id is 0, so what was there before is stored as -1
        known = spark.read.parquet(prototypes_path).filter(F.col("batch_id") < batch_id).drop("batch_id")
        vectors = embed_distinct(batch, ["os"], "templated", embedder)
        assigned, created = C.assign_clusters(batch.join(vectors, ["os", "templated"]), known, threshold)
        write_batch(C.logs_with_cluster(batch, assigned), out, batch_id)
        write_batch(created, prototypes_path, batch_id)

    return start(logs, each)


def enrich_issue_stream(
    issues: DataFrame,
    templates: DataFrame,
    logs: DataFrame,
    out: str,
    classifier: N.Classifier | None = None,
    embedder: Embedder | None = None,
    texts: DataFrame | None = None,
) -> StreamingQuery:
    """Streamed issues (id, ms, seq, os, issue_key, templated_summary, logs array) to the alert table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        done = N.enrich_issues(batch, templates, logs, classifier, embedder, texts)
        alerts = A.with_expiry(A.alert_from_result(done.select("id", "ms", "seq", "os", "issue_key", "log_ids", "result")))
        write_batch(alerts, out, batch_id)

    return start(issues, each)


def enrich_cluster_stream(
    candidates: DataFrame,
    prototypes: DataFrame,
    templates: DataFrame,
    logs: DataFrame,
    out: str,
    relabelled: str,
    classifier: N.Classifier | None = None,
    embedder: Embedder | None = None,
    texts: DataFrame | None = None,
) -> StreamingQuery:
    """Streamed cluster candidates (os, cluster_id, ts) to alerts, and the prototypes they relabel.

    A batch writes the prototypes that it has relabelled and no others, and sees those of the batches
    before it in place of the ones it started with.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        known = prototypes
        if batch_id > 0:
            earlier = batch.sparkSession.read.parquet(relabelled).filter(F.col("batch_id") < batch_id)
            both = prototypes.withColumn("batch_id", F.lit(-1)).unionByName(earlier)
            known = upsert_latest(both, ["os", "cluster_id"], "batch_id").drop("batch_id")
        done, learned = N.enrich_clusters(batch, known, templates, logs, classifier, embedder, texts)
        learned = learned.join(batch.select("os", "cluster_id").distinct(), ["os", "cluster_id"], "left_semi")
        rows = done.select("id", "os", "cluster_id", "result")
        write_batch(A.alert_from_result(rows, "cluster"), out, batch_id)
        write_batch(learned, relabelled, batch_id)

    return start(candidates, each)
