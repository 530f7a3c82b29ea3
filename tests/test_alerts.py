"""Alert listing, feedback, classification and search edges."""

import json

from pyspark.sql import functions as F

from logweave.functions import results as J, rules as R
from logweave.operators import alerts as A, enrichment as N, search as Q

DAY = 86_400_000
COLUMNS = "id string, ms long, seq long, type string, os string, issue_key string, summary string, solution string, result string"


def stream(spark):
    rows = [(f"{d * DAY}-{d}", d * DAY, d, "issue", "linux", "k", "", "", json.dumps({"summary": f"s{d}", "recommendation": "r", "failure_type": "disk"})) for d in range(10)]
    return spark.createDataFrame(rows, COLUMNS)


def test_listing_fills_up_with_older_persisted(spark):
    alerts = stream(spark)
    keyed = alerts.filter("seq = 9").withColumns({"summary": F.lit("own"), "type": F.lit("hash")})
    events = alerts.filter("seq IN (2, 4, 9)").select("id", F.lit(1).alias("ts"))
    rows = A.alerts_enriched(alerts, keyed)
    got = A.list_alerts(rows, rows.limit(0), events, A.newest_ms(rows), 4).collect()
    assert [(r.seq, r.summary, r.persisted) for r in got] == [(9, "own", True), (8, "s8", False), (4, None, True), (2, None, True)]
    assert got[0].type == "hash"
    assert [r.seq for r in A.list_alerts(rows, rows.limit(0), events, A.newest_ms(rows), 1).collect()] == [9]


def test_feedback_is_exclusive_and_latest(spark):
    df = spark.createDataFrame([("a", "correct", 1), ("a", "incorrect", 2), ("b", "incorrect", 1), ("b", "correct", 3)], "id string, feedback string, ts long")
    assert {r.id: r.feedback for r in A.feedback_latest(df).collect()} == {"a": "incorrect", "b": "correct"}


def test_persisted_alert_is_rebuilt(spark):
    alerts = stream(spark)
    marks = spark.createDataFrame([(f"{DAY}-1", 5), (f"{DAY}-1", 4), (f"{3 * DAY}-3", 9)], "id string, ts long")
    got = {r.id: (r.persisted_at, r.rebuilt) for r in A.persisted_alerts(marks, alerts, alerts.filter("seq = 3")).collect()}
    assert got == {f"{DAY}-1": (4, True), f"{3 * DAY}-3": (9, False)}


def test_results_in_odd_json(spark):
    texts = ['{"failure_type":"disk"}', "{'failure_type':'raid'}", "plain", "", None, "[1]", '{"failure_type":5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = df.withColumn("r", J.parse_result(F.col("t"))).select(F.to_json("r").alias("j"), J.result_text(F.col("r"), "failure_type").alias("f")).collect()
    assert [r.f for r in got] == ["disk", "raid", "", "", "", "", "5"]
    assert [json.loads(r.j) for r in got][2:6] == [{"raw": "plain"}, {}, {}, [1]]


def test_query_lists(spark):
    texts = ['{"queries":["a","b","c","d"]}', '["x",1]', '{"queries":"no"}', "bad", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(J.parse_query_list(F.col("t"))).collect()] == [["a", "b", "c"], ["x", "1"], [], [], [], []]


def test_severity(spark):
    df = spark.createDataFrame([("RAID disk",), ("nvme0",), ("wifi",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(R.derive_severity(F.col("t"))).collect()] == ["critical", "warning", "info", "info", "info"]


def test_relevance(spark):
    df = spark.createDataFrame([("disk disks failing on host",)], "t string")
    # whole query, then words of more than three letters; repeated words count each time
    score = df.select(Q.relevance(F.col("t"), ["disk disks", "FAILING disk disk on", "none here"])).first()[0]
    assert score == (1 + 0.5 + 0.5) + (0.5 + 0.5 + 0.5)


def test_keyword_search_reads_strict_results_of_the_whole_stream(spark):
    results = ['{"summary":"disk gone"}', "{'summary':'disk gone'}", "disk gone", "", None, '["disk gone"]']
    rows = [(f"{i}", i, i, "issue", "linux", "k", "", "", "", "", results[i % 6] if i else '{"recommendation":"disk gone","failure_type":"raid"}') for i in range(600)]
    df = spark.createDataFrame(rows, "id string, ms long, seq long, type string, os string, issue_key string, failure_type string, confidence string, summary string, solution string, result string")
    found = Q.search_alerts(df, ["disk gone"], limit=1000).collect()
    assert {r.seq for r in found} == {i for i in range(600) if i % 6 == 0}  # the oldest one is among them
    assert [r.seq for r in Q.search_alerts(df, ["disk gone"], scan=10).collect()] == [594]


def test_structured_search(spark):
    rows = A.alerts_enriched(stream(spark), stream(spark).limit(0))
    assert [r.seq for r in Q.search_alerts_structured(rows, "warning", "Linux", "IS", limit=2).collect()] == [9, 8]
    assert [r.seq for r in Q.search_alerts_structured(rows, ascending=True, limit=2, scan=3).collect()] == [7, 8]
    assert Q.search_alerts_structured(rows, "critical").count() == 0


def test_default_and_own_classifier(spark):
    df = spark.createDataFrame([("linux", ["calm", "overheat", "link down", "link down"]), ("mac", ["calm"]), ("x", [])], "os string, texts array<string>")
    got = [json.loads(r.result) for r in N.classify(df, F.col("texts")).collect()]
    assert [(g["failure_type"], g["confidence"], g["is_hardware_failure"]) for g in got] == [("network", 0.5, True), ("unknown", 0.0, False), ("unknown", 0.0, False)]
    own = N.classify(df.withColumn("recent", N.bullets(F.col("texts"), 2)), F.col("texts"), lambda row: {"failure_type": row["os"], "seen": row["recent"]})
    assert json.loads(own.first().result) == {"failure_type": "linux", "seen": "- calm\n- overheat"}


def test_alert_rows_from_results(spark):
    rows = [("linux", "k", '{"is_hardware_failure":"yes","failure_type":"disk","confidence":0.5}'), ("linux", "k", '{"is_hardware_failure":0}'), ("linux", "k", "junk")]
    got = A.alert_from_result(spark.createDataFrame(rows, "os string, issue_key string, result string")).collect()
    assert [(r.is_hardware_failure, r.failure_type, r.confidence) for r in got] == [(True, "disk", "0.5"), (False, "", ""), (False, "", "")]


def test_results_are_read_once_and_after_the_rows_are_dealt(spark):
    """The filter on a read result must not go below the repartition: one file would then be one task that reads them all."""
    rows = [(i, i, "linux", "", "", ("no json", '{"summary":"disk trouble","failure_type":"disk"}')[i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "ms long, seq long, os string, summary string, solution string, result string").coalesce(1).repartition(4)
    found = Q.search_alerts(df, ["disk trouble"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan[plan.index("Repartition"):]
    assert [r.seq for r in found.collect()] == [5, 3, 1]
