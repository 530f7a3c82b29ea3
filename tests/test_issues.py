"""Sessions and issues against a plain model, under different bucket cuts and partition counts."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import alerts as A, issues as I

GAP = 120


def lines(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 1, 30, 119, 120, 121, 4000])
        # one key holds half of all rows
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}"
        rows.append((i, at, "linux", f"linux|{key}|nopid", f"t{i % 9}", f"raw {i}", key, ""))
    # two rows exactly one gap apart, two just inside it, and one before 1970
    rows += [(n, 10**6, "x", "x|b|1", "t", "r", "b", "1"), (n + 1, 10**6 + GAP, "x", "x|b|1", "t", "r", "b", "1")]
    rows += [(n + 2, 10**6, "x", "x|c|1", "t", "r", "c", "1"), (n + 3, 10**6 + GAP - 1, "x", "x|c|1", "t", "r", "c", "1")]
    rows += [(n + 4, -5, "x", "x|d|1", "t", "r", "d", "1"), (n + 5, 5, "x", "x|d|1", "t", "r", "d", "1")]
    df = spark.createDataFrame(rows, "log_id long, sec long, os string, issue_key string, templated string, line string, component string, pid string")
    return rows, df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


def model(rows):
    """{log_id: session start} and the issues in closing form."""
    starts, issues, last = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key = r[3]
        if key not in last or r[1] - last[key][0] >= GAP:
            last[key] = (r[1], r[1])
        start = last[key][1]
        last[key] = (r[1], start)
        starts[r[0]] = start * 1_000_000
        issues.setdefault((key, start * 1_000_000), []).append(r)
    return starts, issues


@pytest.mark.parametrize("bucket_sec,partitions", [(3600, 4), (60, 1), (100_000_000, 7), (7, 3)])
def test_sessions_and_issues(spark, bucket_sec, partitions):
    rows, df = lines(spark)
    starts, issues = model(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.log_id: r.session_us for r in I.issue_sessions(df, bucket_sec=bucket_sec).collect()}
        assert got == starts
        found = I.build_issues(df, bucket_sec=bucket_sec, max_logs=5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == len(issues)
    for r in found:
        members = issues[(r.issue_key, r.session_us)]
        assert r.n_logs == len(members)
        assert r.last_us == members[-1][1] * 1_000_000
        assert [x.log_id for x in r.logs] == [m[0] for m in members[:5]]
        assert r.templated_summary == " \n".join(m[4] for m in members[:5])


def test_incident_listing_survives_bad_json(spark):
    rows = [(1, "1-a", "linux", "k", "s", '[{"log_id":3,"templated":"t"}]'), (2, "2-b", "linux", "k", "s", "not json"), (3, "3-c", "linux", "k", "s", None)]
    df = spark.createDataFrame(rows, "ms long, id string, os string, issue_key string, templated_summary string, logs string")
    got = I.list_incidents(df, 2).collect()
    assert [r.id for r in got] == ["3-c", "2-b"] and [r.logs for r in got] == [[], []]
    assert I.list_incidents(df).collect()[2].logs[0].log_id == 3


def test_cluster_candidates_at_the_crossing(spark):
    rows = [(i, "linux", "a") for i in range(25)] + [(100 + i, "linux", "b") for i in range(19)]
    df = spark.createDataFrame(rows, "log_id long, os string, cluster_id string").withColumn("ts", F.timestamp_seconds("log_id"))
    assert [(r.cluster_id, r.log_id) for r in I.cluster_candidates(df).collect()] == [("a", 19)]


def test_hand_over_tables_are_dropped_on_request(spark):
    from logweave import session

    path = session.fresh_path(spark, "x")
    spark.range(3).write.parquet(path)
    kept = session.checkpointed(spark.range(5))
    assert kept.count() == 5 and spark.read.parquet(path).count() == 3
    before = session._written[:-2]
    session._written[:] = session._written[-2:]
    session.drop_stages(spark)
    session._written[:] = before
    import os

    assert not os.path.exists(path)


def test_every_log_of_an_issue_is_named(spark):
    rows = [(i, "linux", "linux|k|1", "t", "r", "k", "1", i) for i in range(60)]
    df = spark.createDataFrame(rows, "log_id long, os string, issue_key string, templated string, line string, component string, pid string, sec long")
    df = df.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    entry = I.issue_entries(I.build_issues(df)).first()
    named = I.issue_log_ids(df).collect()
    assert {r.log_id for r in named} == set(range(60)) and {r.issue_mark for r in named} == {entry.id.split("-")[-1]}
    alerts = spark.createDataFrame([(entry.id, "linux", [0, 1])], "id string, os string, log_ids array<long>")
    events = spark.createDataFrame([(entry.id, "correct", 1)], "id string, feedback string, ts long")
    found = A.feedback_logs(alerts, events, df.select("os", "log_id", "templated"), I.issue_log_ids(df))
    assert sorted(r.log_id for r in found.collect()) == list(range(60))


def test_issues_without_logs_move_no_raw_lines(spark):
    """A search reads summaries alone; the lines behind them are not shuffled for it."""
    _, df = lines(spark)
    slim, full = I.build_issues(df, with_logs=False), I.build_issues(df)
    assert slim.columns == full.drop("logs").columns
    assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, full.drop("logs").collect()))
    assert "raw" not in slim._jdf.queryExecution().optimizedPlan().toString()
    assert I.issue_entries(slim).columns == [c for c in I.issue_entries(full).columns if c != "logs"]
