"""Operator inputs derived from the given tables.

Every row of a table takes part; where a table feeds two roles (prototypes and logs, say) each
row has exactly one of them. ``oracle.py`` states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logweave.operators.automations import Rule
from logweave.session import dealt, spread, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table read as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return dealt(spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))


def land_parts(parts: list[DataFrame], path: str, run) -> None:
    """Write one part after the other to ``path`` and run the stream that reads it: each part is a micro-batch, and each run a restart."""
    for part in parts:
        part.write.mode("append").parquet(path)
        run(dealt(part.sparkSession.readStream.schema(part.schema).parquet(path)))


def parted(rows: DataFrame, part: Column, n: int) -> list[DataFrame]:
    marked = rows.withColumn("_p", part)
    return [marked.filter(F.col("_p") == i).drop("_p") for i in range(n)]


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows need text work: spread over the cores."""
    return spread(table(spark, sf_dir, name))


def _s(value: Column) -> Column:
    return value.cast("string")


def event_lines(events: DataFrame) -> DataFrame:
    """Log lines of four source classes with five message kinds, from events (also as a stream)."""
    e = {c: F.col(c) for c in ("event_id", "user_id", "event_type", "value")}
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("I/O error on 10.0.0."), _s(e["user_id"]), F.lit(" sector #"), _s(e["event_id"])))
        .when(F.col("event_type") == "click", F.concat(F.lit("link down on port 0x"), _s(e["user_id"]), F.lit(" code "), _s(e["event_id"] % 7)))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("service httpd failed to start version 1.2."), _s(e["event_id"] % 10)))
        .when(F.col("event_type") == "view", F.concat(F.lit("temperature limit at 12:30:45 value -"), _s(F.round(e["value"] * 100).cast("bigint"))))
        .otherwise(F.concat(F.lit("session opened id="), _s(e["event_id"])))
    )
    source = (
        F.when(F.col("event_id") % 4 == 0, "Linux.log")
        .when(F.col("event_id") % 4 == 1, "Mac.log")
        .when(F.col("event_id") % 4 == 2, "Windows_2k.log")
        .otherwise(F.concat(F.lit("app:"), e["event_type"]))
    )
    pid = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat(F.lit("["), _s(e["user_id"]), F.lit("]")))
    syslog = F.concat(
        F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host"), _s(e["user_id"] % 5), F.lit(" "),
        e["event_type"], pid, F.lit(": "), F.col("body"),
    )
    servicing = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(", Info  CBS    "), F.col("body"))
    return events.withColumn("body", body).select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        source.alias("source"),
        F.when(F.col("event_id") % 4 == 2, servicing).otherwise(syslog).alias("line"),
        F.lit(None).cast("bigint").alias("source_id"),
        "user_id",
        "event_type",
        "value",
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(text_table(spark, sf_dir, "events"))


def _os_by(n: Column) -> Column:
    return F.when(n == 0, "linux").when(n == 1, "macos").otherwise("windows")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with an OS and a role: every tenth is known (prototype), the rest are logs."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        _os_by(F.col("vec_id") % 3).alias("os"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "label",
        F.when(F.col("vec_id") % 10 == 0, "known").otherwise("log").alias("role"),
    )


def known_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("role = 'known'")


def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_vectors(spark, sf_dir).select(
        "os",
        F.concat(F.lit("c"), F.lpad(_s(F.col("vec_id")), 9, "0")).alias("cluster_id"),
        F.col("embedding").alias("centroid"),
        F.concat(F.lit("kind"), _s(F.col("label"))).alias("label"),
        F.lit("keyword_rules").alias("rationale"),
        F.lit(1).alias("size"),
        F.concat(F.lit("known "), _s(F.col("vec_id"))).alias("medoid_document"),
        F.array(_s(F.col("vec_id"))).alias("exemplar_ids"),
        F.lit(None).cast("string").alias("solution"),
    )


def vector_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with vectors; ten texts repeat, so searches meet duplicates."""
    return known_vectors(spark, sf_dir).select(
        "os",
        F.col("vec_id").alias("template_id"),
        F.col("vec_id").alias("id"),
        F.concat(F.lit("template "), _s(F.col("label"))).alias("document"),
        "embedding",
    )


def vector_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("role = 'log'").select(
        "os",
        F.col("vec_id").alias("log_id"),
        F.concat(F.lit("log "), _s(F.col("vec_id"))).alias("document"),
        F.concat(F.lit("k"), _s(F.col("label"))).alias("cluster_id"),
        "embedding",
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_alerts(text_table(spark, sf_dir, "orders"))


def order_alerts(o: DataFrame) -> DataFrame:
    """Alert stream rows, one per order (also as a stream)."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    ft = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "power")
        .when(F.col("o_orderpriority") == "2-HIGH", "storage")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "disk")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "application")
        .otherwise("network")
    )
    conf = F.format_string("%.2f", (F.round(F.col("o_totalprice") * 100).cast("bigint") % 101) / 100.0)
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    os = F.when(cust % 4 == 0, "linux").when(cust % 4 == 1, "macos").when(cust % 4 == 2, "windows").otherwise("unknown")
    good = F.concat(
        F.lit('{"failure_type":"'), ft, F.lit('","confidence":'), conf, F.lit(',"is_hardware_failure":'),
        F.when(ft.isin("application"), "false").otherwise("true"), F.lit(',"summary":"'), ft,
        F.lit(" trouble of customer "), _s(cust), F.lit('","recommendation":"check '), ft, F.lit(' unit"}'),
    )
    result = (
        F.when(key % 9 == 4, F.replace(good, F.lit('"'), F.lit("'")))
        .when(key % 9 == 5, "no answer")
        .otherwise(good)
    )
    return o.select(
        F.concat_ws("-", _s(ms), _s(key)).alias("id"),
        ms.alias("ms"),
        key.alias("seq"),
        F.when(key % 5 == 0, "cluster").otherwise("issue").alias("type"),
        os.alias("os"),
        F.concat(os, F.lit("|cust|"), _s(cust)).alias("issue_key"),
        F.when(key % 5 == 0, F.concat(F.lit("k"), _s(cust % 10))).alias("cluster_id"),
        F.when(key % 4 == 3, "").otherwise(ft).alias("failure_type"),
        F.when(key % 4 == 2, "").otherwise(conf).alias("confidence"),
        F.when(key % 2 == 0, F.concat(F.lit("stream summary "), _s(key))).otherwise("").alias("summary"),
        F.lit("").alias("solution"),
        result.alias("result"),
        F.array(cust, cust + 4).alias("log_ids"),
    )


def keyed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed rows still stored: the others have expired."""
    rows = alerts(spark, sf_dir).filter("seq % 3 <> 0")
    return rows.withColumns(
        {
            "summary": F.when(F.col("seq") % 3 == 1, F.concat(F.lit("keyed summary "), _s(F.col("seq")))).otherwise(""),
            "solution": F.when(F.col("seq") % 6 == 1, "replace the part").otherwise(""),
        }
    )


def persist_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persist marks: every tenth alert, some of them marked twice."""
    a = alerts(spark, sf_dir).filter("seq % 10 = 0").select("id", "ms", "seq")
    again = a.filter("seq % 20 = 0").select("id", (F.col("ms") + 60000).alias("ts"))
    return a.select("id", (F.col("ms") + 1000).alias("ts")).unionByName(again)


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts: by order key correct or incorrect, some changed later."""
    a = alerts(spark, sf_dir).filter("seq % 7 IN (0, 1)").select("id", "ms", "seq")
    first = a.select("id", F.when(F.col("seq") % 7 == 0, "correct").otherwise("incorrect").alias("feedback"), F.col("ms").alias("ts"))
    later = a.filter("seq % 3 = 0").select(
        "id", F.when(F.col("seq") % 7 == 0, "incorrect").otherwise("correct").alias("feedback"), (F.col("ms") + 5000).alias("ts")
    )
    return first.unionByName(later)


# Rules in the shape of the configured ones, over all alerts.
RULES = (
    Rule("swap_shelf", "ansible_tower", failure_type="storage", min_confidence=0.75, cooldown="45m",
         params={"case": "{{ alert.id }}", "where": "{{ alert.os }}/{{ alert.issue_key }}"}),
    Rule("call_facility", "servicenow", failure_type="power", min_confidence=0.6, cooldown="1h",
         params={"subject": "{{ alert.os }} lost power ({{ alert.failure_type }})", "certainty": "{{ alert.confidence }}", "desk": "site"}),
    Rule("any_trouble", "terraform_cloud", min_confidence=0.3, cooldown="4320h",
         params={"message": "{{ alert.result.summary }} {{ alert.result.missing }}"}),
    Rule("page_someone", "pager", failure_type="network", cooldown="x"),
)


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents, one per nation."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        (n + 1).cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        (n % 4 != 3).alias("enabled"),
        F.concat(F.lit("tok"), _s(n % 10)).alias("token"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("a"), _s(n % 2))).alias("agent_id"),
        F.when(n % 5 == 0, F.array(F.lit("host0"), F.lit("host1"))).otherwise(F.array().cast("array<string>")).alias("allowed_hosts"),
    )


def agent_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent metric per event."""
    e = log_lines(spark, sf_dir).withColumnRenamed("log_id", "event_id")
    kind, value = F.col("event_type"), _s(F.round("value", 2))
    name = (
        F.when(kind == "error", " MacOS_log ").when(kind == "view", "cpu_temperature")
        .when(kind == "purchase", "disk").when(kind == "click", "smart_device").otherwise("Queue_Len")
    )
    fields = (
        F.when(kind == "error", F.create_map(F.lit("message"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("line"))))
        .when(kind == "purchase", F.create_map(F.lit("used_percent"), value))
        .when(kind == "click", F.create_map(F.lit("power_on_hours"), _s(F.col("event_id")), F.lit("health_ok"), F.when(F.col("event_id") % 3 == 0, "").otherwise("yes")))
        .otherwise(F.create_map(F.lit("value"), F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.concat(F.lit(" "), value))))
    )
    tags = F.create_map(
        F.lit("host"), F.concat(F.lit("host"), _s(F.col("user_id") % 5)),
        F.lit("device"), F.concat(F.lit("sd"), _s(F.col("user_id") % 3)),
        F.lit("path"), F.lit("/data"),
    )
    stamp = F.when(F.col("event_id") % 13 != 0, F.unix_seconds("ts"))
    return e.select(
        "event_id",
        "ts",
        F.expr("event_id div 10").alias("batch_id"),
        F.struct(name.alias("name"), tags.alias("tags"), fields.alias("fields"), stamp.alias("timestamp")).alias("metric"),
    )


def agent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten metrics."""
    m = agent_metrics(spark, sf_dir)
    batches = m.groupBy("batch_id").agg(
        F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("event_id", F.to_json("metric").alias("j")))).alias("_m")
    )
    schema = "struct<name:string,tags:map<string,string>,fields:map<string,string>,timestamp:bigint>"
    b = F.col("batch_id")
    return batches.select(
        "batch_id",
        "ts",
        F.when(b % 12 == 11, "").otherwise(F.concat(F.lit("tok"), _s(b % 12))).alias("token"),
        F.when(b % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("a"), _s(b % 2))).alias("agent_id"),
        F.transform("_m", lambda x: F.from_json(x["j"], schema)).alias("metrics"),
    )


SNMP_MAPPINGS = ",".join(
    f'{{"oid":"1.3.6.1.{n}","name":"port.speed.{n}","unit":"b"' + (',"scale":0.01}' if n % 4 == 0 else "}")
    for n in range(0, 20, 2)
)
# one oid is mapped twice; the last mapping counts
SNMP_MAPPINGS = '{"oid":"1.3.6.1.2","name":"shadowed"},' + SNMP_MAPPINGS
EXTRACTORS = (
    '{"name":"rack.balance","unit":"C","path":["Thermal","Temperatures"],"field":"ReadingCelsius","attr_key":"Name"},'
    '{"path":["Thermal","Temperatures"],"field":"Slot"}'
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sources, one per nation, all with SNMP mappings and extractors."""
    n = F.col("n_nationkey")
    kinds = F.array(*[F.lit(k) for k in ("filetail", "telegraf", "snmp", "dcim_http", "datadog", "splunk", "thousandeyes")])
    config = F.concat(
        F.lit('{"schema":"'), F.when(n % 2 == 0, "redfish").otherwise("plain"),
        F.lit('","mappings":[' + SNMP_MAPPINGS + '],"extract":[' + EXTRACTORS + "]}"),
    )
    return table(spark, sf_dir, "nation").select(
        (n + 1).cast("bigint").alias("id"),
        F.col("n_name").alias("name"),
        F.get(kinds, n % 7).alias("type"),
        (n % 4 != 3).alias("enabled"),
        config.alias("config"),
    )


def running_pollers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pollers now running: one per supplier nation, and some whose source is gone."""
    s = table(spark, sf_dir, "supplier")
    return s.select((F.col("s_nationkey") * 2 + 1).cast("bigint").alias("id")).distinct()


def snmp_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    value = F.when(k % 13 == 0, "n/a").otherwise(F.concat(F.lit(" "), _s(F.col("p_retailprice")), F.lit(" ")))
    return p.select(
        k.alias("log_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + k).alias("ts"),
        F.concat(F.lit("sw"), _s(k % 7)).alias("host"),
        F.lit(161).alias("port"),
        F.concat(F.lit("1.3.6.1."), _s(k % 20)).alias("oid"),
        value.alias("value"),
        (k % 30 + 1).cast("bigint").alias("source_id"),
    )


def sensor_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor responses: up to ten suppliers of a nation as temperature sensors."""
    s = table(spark, sf_dir, "supplier")
    part = F.expr("s_suppkey div 250")
    item = F.struct(
        "s_suppkey",
        F.concat(
            F.lit('{"Name":"'), F.col("s_name"), F.lit('","ReadingCelsius":'),
            F.when(F.col("s_suppkey") % 9 == 0, '"n/a"').when(F.col("s_suppkey") % 9 == 1, "null").otherwise(F.format_string("%.2f", F.col("s_acctbal"))),
            F.lit(',"Slot":"'), _s(F.col("s_suppkey")), F.lit('"}'),
        ).alias("j"),
    )
    grouped = s.groupBy("s_nationkey", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    items = F.array_join(F.col("_i")["j"], ",")
    return grouped.select(
        (F.col("s_nationkey") * 1_000_000 + F.col("part")).cast("bigint").alias("log_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("s_nationkey")).alias("ts"),
        F.concat(F.lit("https://rack"), _s(F.col("s_nationkey")), F.lit(".example.com/api")).alias("url"),
        F.lit(200).alias("status"),
        F.concat(F.lit('{"Thermal":{"Temperatures":['), items, F.lit("]}}")).alias("body"),
        (F.col("s_nationkey") + 1).cast("bigint").alias("source_id"),
    )


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as sensor responses whose body is no JSON."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.lit(200).alias("status"), F.col("html").alias("body"))


def export_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-search pages: ten turns of the conversations each, every text whole."""
    c = table(spark, sf_dir, "conversations")
    item = F.struct(
        "conv_id", "turn",
        F.struct(F.struct(F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("message")).alias("attributes")).alias("v"),
    )
    grouped = c.groupBy("conv_id", F.expr("turn div 10").alias("page")).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    return grouped.select("conv_id", F.to_json(F.struct(F.col("_i")["v"].alias("data"))).alias("body"))


def export_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-export lines, one per document; some are broken JSON."""
    d = text_table(spark, sf_dir, "documents")
    good = F.to_json(F.struct(F.struct(F.col("text").alias("_raw")).alias("result")))
    return d.select("doc_id", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("{"), good)).otherwise(good).alias("body"))


def alert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network alert pages: one alert per customer."""
    k = F.col("c_custkey")
    alert = F.struct(
        F.when(k % 3 == 0, F.col("c_mktsegment")).alias("ruleName"),
        F.when(k % 3 == 1, "latency").alias("alertType"),
        F.when(k % 2 == 0, "").otherwise(F.col("c_name")).alias("testName"),
        _s(k).alias("testId"),
        F.when(k % 5 == 0, "").otherwise("major").alias("severity"),
        F.when(k % 10 == 0, "minor").alias("level"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("balance "), F.format_string("%.2f", F.col("c_acctbal")))).alias("summary"),
    )
    by_key = F.when(k % 4 == 0, F.to_json(F.struct(F.array(alert).alias("alert")))).otherwise(
        F.to_json(F.struct(F.array(alert).alias("alerts")))
    )
    return table(spark, sf_dir, "customer").select(k.alias("cust_id"), by_key.alias("body"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll times per source (a fifth of the users each): two first polls, three later ones."""
    e = log_lines(spark, sf_dir).groupBy((F.col("user_id") % 5).alias("source_id")).agg(F.max("ts").alias("now"))
    return e.withColumn("since", F.when(F.col("source_id") % 2 == 1, F.col("now") - F.expr("INTERVAL 36 HOURS")))
