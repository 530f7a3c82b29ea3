"""Readers, agent admission, metric points and their edge rows."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from logweave.functions import points as P, rules as R
from logweave.operators import automations as U, metrics as M
from logweave.sources import agents as A, config as C, files as S

LINE = "log_id long, ts timestamp, source string, line string, source_id long"


def points(spark, lines, sources=()):
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1), s, l, n) for i, (s, l, n) in enumerate(lines)]
    src = spark.createDataFrame(list(sources), "id long, config string")
    return M.with_points(spark.createDataFrame(rows, LINE), src)


def flat(df):
    return [(r.log_id, r.name, r.value, r.unit, dict(r.attributes)) for r in M.metric_points(df).orderBy("log_id", "point_no").collect()]


FLOATS = ["1", " 2.5 ", "1_000.5", "-.5", "5.", "1e3", "inf", "nan", "1d", "0x10", "", "n/a", "1__0", "_1", "+7", "1.5f", "１"]


def test_text_floats_equal_python(spark):
    def read(t):
        try:
            return float(t)
        except ValueError:
            return None

    df = spark.createDataFrame([(t,) for t in FLOATS], "t string")
    got = [r[0] for r in df.select(P.text_float(F.col("t"))).collect()]
    for text, value in zip(FLOATS[:-1], got):
        want = read(text)
        assert value == want or (want != want and value != value), text


def test_agent_points(spark):
    def m(name, fields, tags=None, ts=1704067200):
        return ("telegraf:h", json.dumps({"name": name, "tags": tags or {"host": "h"}, "fields": fields, "timestamp": ts}), None)

    lines = [
        m("CPU_Temperature", {"value": "41.5"}), m("smart_device", {"health_ok": None}, {"device": "sda"}), m("smart_device", {"health_ok": True, "power_on_hours": 7}),
        m("smart_device", {"health_ok": []}), m("disk", {"used": 3}), m("disk", {"used_percent": True}, {"path": "/x"}), m("Load", {"value": " 3 "}), m("load", {"value": "x"}),
        m("load", {}), ("telegraf:h", "[1]", None), ("telegraf:h", "{broken", None), ("telegraf:h", "", None), ("other:h", '{"name":"load","fields":{"value":1}}', None), (None, '{"a":1}', None),
        m("load", {"value": {"a": 1}}),
    ]
    df = points(spark, lines)
    assert flat(df) == [
        (0, "system.cpu.temperature", 41.5, "C", {}), (1, "smart.health_ok", 0.0, None, {"device": "sda"}), (2, "smart.health_ok", 1.0, None, {"device": ""}),
        (2, "smart.power_on_hours", 7.0, "h", {"device": ""}), (3, "smart.health_ok", 0.0, None, {"device": ""}), (5, "fs.used_percent", 1.0, "%", {"path": "/x"}), (6, "telegraf.load", 3.0, None, {}),
    ]
    metrics, logs = M.split_metrics_logs(df)
    assert {r.log_id for r in logs.collect()} | {r.log_id for r in metrics.collect()} == set(range(len(lines)))
    assert logs.count() + metrics.select("log_id").distinct().count() == len(lines)


def test_time_comes_from_the_payload_or_the_row(spark):
    lines = [("telegraf:h", '{"name":"a","fields":{"value":1},"timestamp":1.5}', None), ("telegraf:h", '{"name":"a","fields":{"value":1},"timestamp":"x"}', None)]
    got = [r.time_unix_nano for r in M.metric_points(points(spark, lines)).orderBy("log_id").collect()]
    assert got == [1_500_000_000, 1704067200 * 10**9]


def test_snmp_points(spark):
    config = json.dumps({"mappings": [{"oid": "1.1", "name": "old"}, {"oid": "1.1", "name": "up", "scale": 0.5, "unit": "s", "type": "sum"}, {"oid": "1.2"}, {"name": "no oid"}, {"oid": "1.3", "scale": "bad"}]})
    def r(oid, value):
        return ("snmp:sw", json.dumps({"host": "sw", "oid": oid, "value": value}), 9)

    lines = [r("1.1", "10"), r("1.2", "x"), r("1.2", "4"), r("1.9", "4"), r("1.3", "4"), ("snmp:sw", json.dumps({"oid": "1.1", "value": "1"}), 77)]
    assert flat(points(spark, lines, [(9, config)])) == [(0, "up", 5.0, "s", {"oid": "1.1"}), (2, "1.2", 4.0, None, {"oid": "1.2"})]


def test_sensor_points(spark):
    body = {"Thermal": {"Temperatures": [{"Name": "a", "ReadingCelsius": 1.5}, {"ReadingCelsius": "2"}, {"Name": "c"}, 7, {"Name": "d", "ReadingCelsius": "hot"}]}, "x": {"y": 3}}
    plain = json.dumps({"extract": [{"path": ["Thermal", "Temperatures"], "field": "ReadingCelsius", "name": "t", "attr_key": "Name"}, {"path": ["x", "y"], "field": "z"}, {"path": [], "field": "q"}, {"path": ["Thermal", "Temperatures"]}]})
    lines = [("dcim_http:r", json.dumps({"url": "u", "status": 200, "body": body}), n) for n in (1, 2, 3)] + [("dcim_http:r", json.dumps({"body": "text"}), 1)]
    df = points(spark, lines, [(1, plain), (2, '{"schema":"redfish"}')])
    assert flat(df) == [
        (0, "t", 1.5, None, {"Name": "a"}), (0, "t", 2.0, None, {}),
        (1, "redfish.temperature.celsius", 1.5, "C", {"Name": "a"}), (1, "redfish.temperature.celsius", 2.0, "C", {}),
    ]


def test_own_normalizer(spark):
    def fn(payload, config, now):
        return P.point(F.lit("x"), P.variant_float(P.get(payload, "$.v")), now, P.string_map(("a", F.lit("b"))))

    import datetime

    df = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "mine:1", '{"v": 2}', None)], LINE)
    made = M.with_points(df, spark.createDataFrame([], "id long, config string"), {"mine": fn})
    assert [(r.name, r.value) for r in M.metric_points(made).collect()] == [("x", 2.0)]


def test_export_overlay_and_limit(spark):
    rows = [(i, 0, "" if i == 1 else "n", "", float(i), {"a": "1", "b": "2"}, {"b": "3"}, i) for i in range(5)]
    df = spark.createDataFrame(rows, "log_id long, point_no int, name string, unit string, value double, resource map<string,string>, attributes map<string,string>, time_unix_nano long")
    got = M.metric_export_rows(df).orderBy("log_id").collect()
    assert [r.name for r in got] == ["n", "metric.value", "n", "n", "n"] and got[0].attributes == {"a": "1", "b": "3"} and got[0].unit is None
    # the limit counts the points of a message
    many = df.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("log_id"), *[c for c in df.columns if c not in ("log_id", "point_no")])
    points = many.filter("value = 0").withColumn("point_no", F.explode(F.sequence(F.lit(0), F.lit(599))))
    assert M.metric_export_rows(points, 1000).count() == M.metric_export_rows(points).count() == 1800
    assert M.metric_export_rows(points, 500).groupBy("log_id").count().filter("count <> 500").count() == 0


def test_recent_metrics_cuts_before_it_filters(spark):
    rows = [(i, "redfish.t" if i % 2 else "other", json.dumps({"vendor": "a" if i < 8 else "b"})) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, name string, resource string")
    assert [r.id for r in M.recent_metrics(df, 4, vendor="b").collect()] == [8, 9]
    assert [r.id for r in M.recent_metrics(df, 4, schema="redfish").collect()] == [7, 9]
    assert M.recent_metrics(df, 0).count() == 1


def test_admission(spark):
    agents = [(2, "two", True, "t", "", []), (1, "one", True, "t", "a1", []), (3, "off", False, "u", "", []), (4, "list", True, "v", "", ["h1"]), (5, "blank", True, "", "", [])]
    adf = spark.createDataFrame(agents, "id long, name string, enabled boolean, token string, agent_id string, allowed_hosts array<string>")
    def b(i, token, agent, *hosts):
        return (i, token, agent, [("m", {"host": h} if h else {}, {"value": "1"}, None) for h in hosts])

    rows = [b(1, "t", None, "x"), b(2, "t", "a1", "x"), b(3, "t", "zz", "x"), b(4, "u", None, "x"), b(5, "v", None, "h0", "h1"), b(6, "v", None, "h0", ""), b(7, "", None, "x"), b(8, None, None, "x"), b(9, "nope", None)]
    bdf = spark.createDataFrame(rows, f"batch_id long, token string, agent_id string, metrics array<{A.METRIC_FIELDS}>")
    got = {r.batch_id: (r.source_id, r.reason) for r in A.admit_agent_batches(bdf, adf).collect()}
    assert got == {1: (1, ""), 2: (1, ""), 3: (2, ""), 4: (None, "unknown token"), 5: (4, ""), 6: (4, "host not allowed"), 7: (None, "missing token"), 8: (None, "missing token"), 9: (None, "unknown token")}


def test_text_files(spark, tmp_path):
    (tmp_path / "Linux.log").write_bytes("  one \r\n\ttwo é\r\n\r\nbad \xff byte".encode("latin-1").replace(b"\xe9", "é".encode()))
    (tmp_path / "Mac 1.log").write_text("m\n")
    got = sorted((r.source, r.line) for r in S.scan_text_logs(spark, str(tmp_path)).collect())
    assert got == [("Linux.log", ""), ("Linux.log", "bad � byte"), ("Linux.log", "one"), ("Linux.log", "two é"), ("Mac 1.log", "m")]


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_template_numbers_over_file_blocks(spark, tmp_path, split):
    rows = [("" if i % 3 == 0 else f"E{i}", " " if i % 7 == 2 else f' t {i}, "q" <*> ') for i in range(500)]
    path = tmp_path / "Linux_2k.log_templates.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("EventId", "EventTemplate"), *rows])
    want, n = [], 0
    for event, text in rows:
        if text.strip():
            want.append((event or f"auto_{n}", text.strip()))
            n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [(r.event_id, r.template) for r in S.load_templates(spark, str(path)).collect()]
        assert sorted(got) == sorted(want)
        counts = S.template_counts(S.load_all_templates(spark, str(tmp_path))).collect()
        assert [(r.os, r.n_templates) for r in counts] == [("linux", len(want))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_landed_exports(spark, tmp_path):
    def land(name, *docs):
        path = tmp_path / name
        path.write_text("\n".join(docs))
        return str(path)

    pages = land("a", '{"data":[{"attributes":{"message":" x "}},{"attributes":{"message":""}},{"attributes":null},{}]}', "broken", '{"data":null}')
    assert [tuple(r) for r in C.read_source(spark, "datadog", pages).collect()] == [("datadog:unknown", "x")]
    assert C.read_source(spark, "datadog", pages, os="Linux").first().source == "datadog:linux"
    nd = land("b", '{"result":{"_raw":"r1"}}', '{"result":{}}', "oops", '{"preview":true}')
    assert [tuple(r) for r in C.read_source(spark, "splunk", nd).collect()] == [("splunk:unknown", "r1")]
    al = land("c", '{"alerts":[],"alert":[{"alertType":"a","testId":5,"level":"low"}]}', '{"alerts":[{"ruleName":"r","summary":"s"},{}]}')
    assert sorted(r.line for r in C.read_source(spark, "thousandeyes", al).collect()) == ["a 5 low", "alert", "r s"]
    http = land("d", '{"url":"https://R1.x:8/p","status":200,"body":"{\\"a\\":1}","source_id":3}', '{"url":"nohost","status":500,"body":"plain"}', '{"url":"","status":1,"body":""}')
    got = {r.source: json.loads(r.line) for r in C.read_source(spark, "dcim_http", http).collect()}
    assert got == {"dcim_http:r1.x": {"url": "https://R1.x:8/p", "status": 200, "body": {"a": 1}}, "dcim_http:unknown": {"url": "nohost", "status": 500, "body": "plain"}}
    snmp = land("e", '{"host":"sw","port":161,"oid":"1.2","value":"5"}')
    row = C.read_source(spark, "snmp", snmp).first()
    assert (row.source, json.loads(row.line)) == ("snmp:sw", {"host": "sw", "port": 161, "community": "***", "oid": "1.2", "value": "5"})
    with pytest.raises(ValueError):
        C.read_source(spark, "nope", snmp)


def test_rule_files(spark, tmp_path):
    (tmp_path / "failures.json").write_text('{"rules": [{"name": "fan", "pattern": "fan (stopped|slow)"}]}')
    (tmp_path / "actions.yml").write_text("rules:\n  - id: a\n    match: {failure_type: fan, min_confidence: 0.5}\n    action: {provider: pager}\n    cooldown: 5m\n")
    (tmp_path / "empty.json").write_text("")
    assert R.read_failure_rules(C.read_config_file(spark, f"{tmp_path}/failures.json")) == (("fan", "fan (stopped|slow)"),)
    assert R.read_failure_rules(C.read_config_file(spark, f"{tmp_path}/empty.json")) == R.FAILURE_RULES
    rule = U.read_rules(C.read_config_file(spark, f"{tmp_path}/actions.yml")["rules"])[0]
    assert (rule.id, rule.failure_type, rule.min_confidence, rule.provider, rule.cooldown) == ("a", "fan", 0.5, "pager", "5m")
