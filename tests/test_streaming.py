"""Streams over several micro-batches against the batch operators on the same rows."""

import datetime
import json
import random

from pyspark.sql import functions as F

from logweave.operators import automations as U, issues as I, logs as L
from logweave.plans import fixtures as X
from logweave.streaming import state as S, tables as B

EPOCH = datetime.datetime(2024, 1, 1)


def land(df, path, order, parts):
    """Rows as ``parts`` files in time order, so that each is a micro-batch of its own."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // parts)
    for n in range(parts):
        part = df.sparkSession.createDataFrame(rows[n * step : (n + 1) * step], df.schema)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def log_rows(spark, n=400):
    at, rows = 0, []
    for i in range(n):
        at += (0, 1, 50, 120, 119, 300, 7)[i % 7]
        rows.append((i, EPOCH + datetime.timedelta(seconds=at), ("Linux.log", "app:x", "Mac.log")[i % 3], f"Jan  1 00:00:01 h svc{i % 2}[{i % 4}]: io error {i}"))
    # a last row far later lets the watermark close everything before it
    rows.append((n, EPOCH + datetime.timedelta(days=5), "app:end", "the end"))
    rows.append((n + 1, EPOCH + datetime.timedelta(days=6), "app:end", "the end"))
    return spark.createDataFrame(rows, "log_id long, ts timestamp, source string, line string")


def test_stream_issues_equal_batch(spark, tmp_path):
    lines = log_rows(spark)
    stream = L.parse_and_template(land(lines, tmp_path / "in", "ts", 6))
    S.stream_issues(stream, str(tmp_path / "out"), max_logs=7).awaitTermination()
    got = S.closed_issues(spark, str(tmp_path / "out")).collect()
    want = I.build_issues(L.parse_and_template(lines), max_logs=7).filter("n_logs > 0").collect()
    seen = {(r.os, r.issue_key, r.session_us, r.last_us, r.n_logs, r.templated_summary) for r in got}
    all_ = {(r.os, r.issue_key, r.session_us, r.last_us, r.n_logs, r.templated_summary) for r in want}
    last = max(r.last_us for r in want)
    assert seen == {x for x in all_ if x[3] < last} and len(got) == len(seen)
    logs = {(r.issue_key, r.session_us): [x["log_id"] for x in json.loads(r.logs)] for r in got}
    assert all(logs[r.issue_key, r.session_us] == [x.log_id for x in r.logs] for r in want if r.last_us < last)


def test_stream_issues_equal_batch_in_any_order(spark, tmp_path):
    lines = log_rows(spark, 120)
    whole = L.parse_and_template(lines)
    rows = lines.orderBy("ts").collect()
    rng = random.Random(3)
    for n in range(0, 120, 20):  # files overlap in time by less than the watermark
        part = rows[n : n + 20]
        rows[n : n + 20] = part[::2] + part[1::2] if n % 40 else part[1::2] + part[::2]
    files = [rows[:30:2], rows[1:30:2]] + [rows[30:70], rows[70:]]
    for f in files:
        rng.shuffle(f)
        spark.createDataFrame(f, lines.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.stream_issues(L.parse_and_template(stream), str(tmp_path / "out"), max_logs=5, watermark="6 hours").awaitTermination()
    got = S.closed_issues(spark, str(tmp_path / "out")).collect()
    want = I.build_issues(whole, max_logs=5).collect()
    cols = lambda r: (r.os, r.issue_key, r.session_us, r.last_us, r.n_logs, r.templated_summary)
    last = max(r.last_us for r in want)
    assert {cols(r) for r in got} == {cols(r) for r in want if r.last_us < last} and len(got) == len({cols(r) for r in got})


def test_stream_candidates_once(spark, tmp_path):
    rows = [(i, "linux", "a" if i % 3 else "b") for i in range(75)]
    df = spark.createDataFrame(rows, "log_id long, os string, cluster_id string")
    S.stream_cluster_candidates(land(df, tmp_path / "in", "log_id", 5), str(tmp_path / "out")).awaitTermination()
    assert sorted(tuple(r) for r in S.stream_candidates(spark, str(tmp_path / "out")).collect()) == [("linux", "a"), ("linux", "b")]
    S.stream_cluster_candidates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "few"), 26).awaitTermination()
    assert [r.cluster_id for r in S.stream_candidates(spark, str(tmp_path / "few")).collect()] == ["a"]


def test_restarts_and_half_written_batches(spark, tmp_path):
    """A stream that stops after any batch goes on from its commit; a batch without a commit is not read and is written anew."""
    lines = log_rows(spark, 150)
    rows = lines.orderBy("ts").collect()
    files = [rows[:40], rows[40:80], rows[20:22] + rows[80:120], rows[120:]]  # two rows come again, far too late
    out, path, checkpoint = str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for n, part in enumerate(files):
        spark.createDataFrame(part, lines.schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(lines.schema).parquet(path)
        S.stream_issues(L.parse_and_template(stream), out, watermark="1 hour", checkpoint=checkpoint).awaitTermination()
        assert B.last_commit(spark, out)["batch"] == n
    late, taken = S.late_rows(spark, out), S.taken_rows(spark, out)
    assert sorted(r.log_id for r in late.collect()) == [rows[20].log_id, rows[21].log_id]
    assert taken.count() == len(rows) and taken.distinct().count() == len(rows)
    cols = lambda r: (r.os, r.issue_key, r.session_us, r.last_us, r.n_logs, r.templated_summary)
    want = I.build_issues(L.parse_and_template(lines)).collect()
    last = max(r.last_us for r in want)
    got = [cols(r) for r in S.closed_issues(spark, out).collect()]
    assert sorted(got) == sorted(cols(r) for r in want if r.last_us < last)
    B.write_batch(S.closed_issues(spark, out), f"{out}/issues", 99)  # never committed
    assert len(S.closed_issues(spark, out).collect()) == len(got)


def test_files_of_a_batch_without_a_commit_are_not_opened(spark, tmp_path):
    out = tmp_path / "out"
    B.write_batch(spark.createDataFrame([(1,)], "n bigint"), f"{out}/rows", 0)
    B.commit(spark, str(out), 0)
    half = out / "rows" / "batch_id=1"
    half.mkdir()
    (half / "part-00000.parquet").write_bytes(b"cut off")
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
    try:
        assert [r.n for r in B.read_committed(spark, str(out), "rows", "n bigint").collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.optimizer.dynamicPartitionPruning.enabled")


def test_a_replayed_batch_emits_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([(i, "linux", "a") for i in range(30)], "log_id long, os string, cluster_id string")
    out = str(tmp_path / "out")
    for checkpoint in ("one", "two"):  # a lost checkpoint replays all batches
        stream = land(df, tmp_path / "in", "log_id", 3) if checkpoint == "one" else spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        S.stream_cluster_candidates(stream, out, checkpoint=str(tmp_path / checkpoint)).awaitTermination()
        assert [tuple(r) for r in S.stream_candidates(spark, out).collect()] == [("linux", "a")]


def test_stream_fires_equal_batch(spark, tmp_path):
    # cooldowns run out and are forgotten while the stream is still running
    base = 1_700_000_000_000
    rows = [(f"{i}", base + i * 400 + (i // 100) * 900_000, i, "linux", f"k{i % 3}", "power", "0.9", None) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, ms long, seq long, os string, issue_key string, failure_type string, confidence string, result string")
    rules = [U.Rule("a", "servicenow", failure_type="power", cooldown="7s"), U.Rule("b", "pager", min_confidence=0.95), U.Rule("c", "pager", cooldown="1m")]
    stream = U.match_automations(land(df, tmp_path / "in", "ms", 5), rules)
    S.stream_fires(stream, str(tmp_path / "out")).awaitTermination()
    got = {(r.rule_id, r.id) for r in S.fires(spark, str(tmp_path / "out")).collect()}
    assert S.late_matches(spark, str(tmp_path / "out")).count() == 0
    want = U.cooldown_fires(U.match_automations(df, rules), 20)
    assert got == {(r.rule_id, r.id) for r in want.collect()} and len(got) > 20
    acted = U.actions(want)
    assert {r.provider for r in acted.collect()} == {"servicenow"}
    stats = {r.provider: r.triggered for r in U.automation_stats(acted).collect()}
    assert stats[None] == stats["servicenow"]


def prototypes(spark):
    return spark.createDataFrame([], "os string, cluster_id string, centroid array<double>, label string, rationale string, size int, medoid_document string, exemplar_ids array<string>, solution string")


def test_consume_writes_three_tables_and_replays_harmlessly(spark, tmp_path):
    metric = '{"name":"load","fields":{"value":2},"tags":{"host":"h"}}'
    rows = [(1, EPOCH, "telegraf:h", metric, None), (2, EPOCH, "Linux.log", "Jan  1 00:00:01 h c[5]: io error 7", None), (3, EPOCH, "telegraf:h", "[]", None), (4, EPOCH, "app", "calm", None)]
    df = spark.createDataFrame(rows, B.LINE_SCHEMA)
    sources = spark.createDataFrame([], "id long, config string")
    out = str(tmp_path / "out")
    for _ in range(2):
        stream = land(df, tmp_path / "in", "log_id", 2) if not (tmp_path / "in").exists() else spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        B.consume(stream, sources, prototypes(spark), out).awaitTermination()
        assert [r.name for r in B.read_table(spark, f"{out}/metrics").collect()] == ["telegraf.load"]
        assert sorted(r.log_id for r in B.read_table(spark, f"{out}/logs").collect()) == [2, 3, 4]
        found = {r.log_id: (r.rule_label, r.nearest_distance) for r in B.read_table(spark, f"{out}/candidates").collect()}
        assert found == {2: ("disk", None), 3: ("unknown", None), 4: ("unknown", None)}


def test_assign_shares_prototypes_between_batches(spark, tmp_path):
    rows = [(i, "linux", f"disk {('alpha', 'beta')[i % 2]} failed") for i in range(8)]
    df = spark.createDataFrame(rows, "log_id long, os string, templated string")
    table, out = str(tmp_path / "protos"), str(tmp_path / "out")
    B.write_batch(prototypes(spark), table, -1)
    B.assign(land(df, tmp_path / "in", "log_id", 4), table, out, threshold=0.05).awaitTermination()
    got = B.read_table(spark, out).collect()
    assert len(got) == 8
    assert len({r.cluster_id for r in got}) == 2 == B.read_table(spark, table).count()
    assert len({(r.cluster_id, r.templated) for r in got}) == 2


def test_envelopes(spark):
    rows = [('{"log_id":1,"ts":"2024-01-01T00:00:00Z","source":"s","line":"l"}',), ("nope",), ('{"log_id":"x","ts":"2024-01-01T00:00:00Z","line":"l"}',), ('{"log_id":2,"line":"l"}',)]
    lines, rejects = B.read_envelopes(spark.createDataFrame(rows, "value string"))
    assert [r.log_id for r in lines.collect()] == [1]
    assert {r.value: r.reason for r in rejects.collect()} == {rows[1][0]: "not json", rows[2][0]: "missing log_id", rows[3][0]: "missing ts"}


def test_a_landed_part_is_dealt_over_all_cores(spark, tmp_path):
    """One file would make one task, which parses all lines of the batch."""
    seen = []

    def run(stream):
        each = lambda batch, n: seen.append([len(rows) for rows in batch.rdd.glom().collect()])
        B.start(stream, each, str(tmp_path / "checkpoint")).awaitTermination()

    X.land_parts([spark.range(400).coalesce(1), spark.range(400, 800).coalesce(1)], str(tmp_path / "landed"), run)
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and seen == [[400 // cores] * cores] * 2


def test_an_envelope_is_read_once(spark, tmp_path):
    """Rejects and lines come from one pass over a batch; each used to read all envelopes again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    whole = '{{"log_id":{0},"ts":"2024-01-01T00:00:00Z","source":"Linux.log","line":"io error {0}"}}'
    rows = [(whole.format(i) if i % 4 else f"broken {i}",) for i in range(40)]
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, "value string").coalesce(1).write.parquet(landed)
    raw = spark.readStream.schema("value string").parquet(landed).select(counted("value").alias("value"))
    sources = spark.createDataFrame([], "id long, config string")
    B.consume_envelopes(raw, sources, prototypes(spark), out).awaitTermination()
    assert made.value == 40
    assert sorted(r.value for r in B.read_table(spark, f"{out}/rejects").collect()) == sorted(v for v, in rows if v.startswith("broken"))
    assert sorted(r.log_id for r in B.read_table(spark, f"{out}/logs").collect()) == [i for i in range(40) if i % 4]
