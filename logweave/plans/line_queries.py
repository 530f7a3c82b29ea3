"""Queries over log lines: routing, parsing, masking, signals, issues."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.functions import rules as R, text as T
from logweave.operators import issues as I, logs as L, upsert as U
from logweave.plans import fixtures as X, oracle as O
from logweave.plans.registry import query
from logweave.session import fresh_path
from logweave.sources import config as C, exports as E, files as S

SYSLOG, SERVICING = T.SYSLOG_PATTERN, T.SERVICING_PATTERN


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_and_template(X.log_lines(spark, sf_dir))


@query("scan_text_logs", f"WITH {O.LINES} SELECT source, trim(line) AS line FROM log_lines")
def scan_text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to one folder per log file, read back as text files named like their source."""
    base = fresh_path(spark, "text-logs")
    lines = X.log_lines(spark, sf_dir).select(F.concat(F.lit("  "), F.col("line"), F.lit("\t")).alias("value"), "source")
    parts = []
    lines.withColumn("file", F.regexp_replace("source", ":", "-")).drop("source").write.partitionBy("file").text(base)
    for name in ("Linux.log", "Mac.log", "Windows_2k.log", *(f"app:{t}" for t in ("signup", "purchase", "error", "view", "click"))):
        found = S.scan_text_logs(spark, f"{base}/file={name.replace(':', '-')}")
        parts.append(found.select(F.lit(name).alias("source"), "line"))
    return functools.reduce(DataFrame.unionByName, parts)


CATALOGUE = """
d AS (SELECT doc_id, trim(regexp_replace(lang || ' ' || source || ' ' || n_chars, '\\s+', ' ', 'g')) AS t,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'E' || doc_id END AS event_id FROM documents),
kept AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM d WHERE doc_id % 7 <> 2)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> str:
    """A template catalogue file derived from the documents; every seventh template is blank."""
    path = fresh_path(spark, "templates")
    d = X.text_table(spark, sf_dir, "documents")
    text = F.concat_ws(" ", "lang", "source", F.col("n_chars").cast("string"))
    rows = d.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("E"), F.col("doc_id"))).alias("EventId"),
        F.when(F.col("doc_id") % 7 == 2, " ").otherwise(F.concat(F.lit(' '), text, F.lit(', "x" '))).alias("EventTemplate"),
    )
    ordered = rows.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    ordered.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


TEMPLATES_SQL = f"""WITH {CATALOGUE}
SELECT CASE WHEN event_id = '' THEN 'auto_' || n ELSE event_id END AS event_id, t || ', "x"' AS template FROM kept"""


@query("load_templates", TEMPLATES_SQL)
def load_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_templates(spark, _catalogue(spark, sf_dir))


@query(
    "template_counts",
    f"WITH {CATALOGUE}, o(os) AS (VALUES ('linux'), ('windows')) SELECT os, count(*) AS n_templates FROM kept, o GROUP BY os",
)
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _catalogue(spark, sf_dir)
    folder, name = path.rsplit("/", 1)
    files = {"macos": "absent.csv", "linux": name, "windows": name}
    return S.template_counts(S.load_all_templates(spark, folder, files))


@query(
    "ingest_export_pages",
    "SELECT conv_id, 'datadog:linux' AS source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM conversations WHERE text IS NOT NULL",
)
def ingest_export_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ingest_export_pages(X.export_pages(spark, sf_dir), os="Linux")


@query(
    "ingest_ndjson_raw",
    "SELECT doc_id, 'splunk:unknown' AS source, text AS line FROM documents WHERE doc_id % 10 <> 3 AND text <> ''",
)
def ingest_ndjson_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ingest_ndjson_raw(X.export_ndjson(spark, sf_dir))


@query(
    "ingest_alert_lines",
    """SELECT c_custkey AS cust_id, 'thousandeyes:unknown' AS source, concat_ws(' ',
      CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'latency' ELSE 'alert' END,
      CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_name END,
      CASE WHEN c_custkey % 10 = 0 THEN 'minor' WHEN c_custkey % 5 = 0 THEN NULL ELSE 'major' END,
      CASE WHEN c_custkey % 7 <> 0 THEN 'balance ' || printf('%.2f', c_acctbal) END) AS line FROM customer""",
)
def ingest_alert_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ingest_alert_lines(X.alert_pages(spark, sf_dir))


@query(
    "incremental_window",
    f"""WITH {O.LINES}, polls AS (
      SELECT user_id % 5 AS source_id, max(ts) AS now FROM log_lines GROUP BY 1)
    SELECT l.log_id, p.source_id FROM log_lines l JOIN polls p ON l.user_id % 5 = p.source_id
    WHERE l.ts >= p.now - CASE WHEN p.source_id % 2 = 1 THEN INTERVAL 36 HOURS ELSE INTERVAL 5 MINUTES END""",
)
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    landed = X.log_lines(spark, sf_dir).withColumn("source_id", F.col("user_id") % 5)
    return E.incremental_window(landed, X.polls(spark, sf_dir)).select("log_id", "source_id")


@query(
    "wrap_http_payloads",
    """SELECT page_id, 'dcim_http:' || coalesce(nullif(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), ''), 'unknown') AS source,
      url, 200::BIGINT AS status, html AS body FROM pages WHERE url <> ''""",
)
def wrap_http_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrapped line is read back, so that the whole page is compared and not its JSON spelling."""
    wrapped = E.wrap_http_payloads(X.page_responses(spark, sf_dir))
    back = F.from_json("line", "struct<url:string,status:bigint,body:string>")
    return wrapped.withColumn("_b", back).select("page_id", "source", "_b.*")


@query(
    "wrap_snmp_readings",
    """SELECT p_partkey AS log_id, 'snmp:sw' || (p_partkey % 7) AS source,
      '{"host":"sw' || (p_partkey % 7) || '","port":161,"community":"***","oid":"1.3.6.1.' || (p_partkey % 20) || '","value":"'
        || CASE WHEN p_partkey % 13 = 0 THEN 'n/a' ELSE ' ' || p_retailprice || ' ' END || '"}' AS line FROM part""",
)
def wrap_snmp_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.wrap_snmp_readings(X.snmp_readings(spark, sf_dir)).select("log_id", "source", "line")


SOURCES_SQL = """
sources AS (SELECT n_nationkey + 1 AS id, n_name AS name, n_nationkey % 4 <> 3 AS enabled, n_nationkey % 7 AS t FROM nation),
running AS (SELECT DISTINCT s_nationkey * 2 + 1 AS id FROM supplier)"""


@query(
    "reconcile_sources",
    f"""WITH {SOURCES_SQL}
    SELECT id::BIGINT AS id, 'stop' AS action FROM running WHERE id NOT IN (SELECT id FROM sources WHERE enabled)
    UNION ALL SELECT id::BIGINT, 'start' FROM sources WHERE enabled AND t <> 1 AND id NOT IN (SELECT id FROM running)""",
)
def reconcile_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reconcile_sources(X.sources(spark, sf_dir), X.running_pollers(spark, sf_dir))


@query("list_sources", f"WITH {SOURCES_SQL} SELECT id::BIGINT AS id, name, enabled FROM sources ORDER BY id DESC")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.list_sources(X.sources(spark, sf_dir)).select("id", "name", "enabled")


@query(
    "upsert_latest",
    f"""WITH {O.PARSED}
    SELECT os, issue_key, max(log_id) AS log_id, max_by(templated, log_id) AS templated FROM parsed GROUP BY os, issue_key""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upsert_latest(parsed(spark, sf_dir), ["os", "issue_key"], "log_id").select("os", "issue_key", "log_id", "templated")


@query(
    "fetch_by_ids",
    f"""WITH {O.LINES} SELECT log_id, line FROM log_lines
    WHERE log_id IN (SELECT o_custkey FROM orders UNION ALL SELECT o_custkey + 4 FROM orders)""",
)
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = X.alerts(spark, sf_dir).select(F.explode("log_ids").alias("log_id"))
    return U.fetch_by_ids(X.log_lines(spark, sf_dir), ids, "log_id").select("log_id", "line")


@query("os_from_source", f"WITH {O.PARSED} SELECT os, count(*) AS n FROM parsed GROUP BY os")
def os_from_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.log_lines(spark, sf_dir).withColumn("os", T.os_from_source(F.col("source")))
    return lines.groupBy("os").agg(F.count(F.lit(1)).alias("n"))


@query(
    "normalize_os",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'macos' WHEN 1 THEN 'macos' WHEN 2 THEN 'windows' WHEN 3 THEN 'linux'
      WHEN 4 THEN 'unknown' ELSE lower(c_mktsegment) END AS os,
      CASE WHEN c_custkey % 6 = 4 THEN '' WHEN c_custkey % 6 IN (0, 1) THEN 'macos' WHEN c_custkey % 6 = 2 THEN 'windows'
      WHEN c_custkey % 6 = 3 THEN 'linux' ELSE lower(c_mktsegment) END AS templates_os FROM customer""",
)
def normalize_os(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    name = (
        F.when(k == 0, " Mac ").when(k == 1, "OSX").when(k == 2, "WIN").when(k == 3, "Linux")
        .when(k == 4, " ").otherwise(F.col("c_mktsegment"))
    )
    return X.table(spark, sf_dir, "customer").select(
        "c_custkey", T.normalize_os(name).alias("os"), T.normalize_os(name, empty="").alias("templates_os")
    )


PARSE_COLS = ("month", "date", "time", "component", "pid", "content")


def _parse_sql(os: str, more: str) -> str:
    cols = ", ".join(f"CASE WHEN ok THEN p.{c} END AS {c}" for c in PARSE_COLS if c != "component")
    return f"""WITH {O.PARSED} SELECT log_id, ok, {cols}, CASE WHEN ok THEN trim(p.component) END AS component, {more}
    FROM parts WHERE os = '{os}'"""


def _level_sql(text: str) -> str:
    return f"upper(regexp_extract({text}, '(?i){T.LEVEL_PATTERN}', 1))"


def _address_sql(text: str) -> str:
    return f"regexp_extract({text}, '{T.ADDRESS_PATTERN}', 0)"


def _parse(spark: SparkSession, sf_dir: str, os: str) -> DataFrame:
    lines = X.log_lines(spark, sf_dir).filter(T.os_from_source(F.col("source")) == os)
    return lines.withColumn("_p", T.parse_syslog(F.col("line")))


@query("parse_linux", _parse_sql("linux", f"CASE WHEN ok THEN {_level_sql('p.content')} END AS level"))
def parse_linux(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parse(spark, sf_dir, "linux")
    return rows.select(
        "log_id", F.col("_p").isNotNull().alias("ok"), *[f"_p.{c}" for c in PARSE_COLS],
        T.level_token(F.col("_p.content")).alias("level"),
    )


@query(
    "parse_macos",
    _parse_sql("macos", f"CASE WHEN ok THEN p.host END AS \"user\", CASE WHEN ok THEN {_address_sql('p.content')} END AS address"),
)
def parse_macos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parse(spark, sf_dir, "macos")
    return rows.select(
        "log_id", F.col("_p").isNotNull().alias("ok"), *[f"_p.{c}" for c in PARSE_COLS],
        F.col("_p.host").alias("user"), T.address_token(F.col("_p.content")).alias("address"),
    )


@query(
    "parse_windows",
    f"""WITH {O.LINES}, m AS (SELECT log_id, regexp_matches(line, '{SERVICING}') AS ok,
      regexp_extract(line, '{SERVICING}', ['date', 'time', 'level', 'component', 'content']) AS p
      FROM log_lines WHERE source = 'Windows_2k.log')
    SELECT log_id, ok, p.date AS date, p.time AS time, p.level AS level, p.component AS component, p.content AS content FROM m""",
)
def parse_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.log_lines(spark, sf_dir).filter(T.os_from_source(F.col("source")) == "windows")
    rows = lines.withColumn("_p", T.parse_servicing(F.col("line")))
    return rows.select("log_id", F.col("_p").isNotNull().alias("ok"), "_p.*")


@query("extract_level", f"SELECT doc_id, coalesce({_level_sql('text')}, '') AS level FROM documents")
def extract_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_table(spark, sf_dir, "documents").select("doc_id", T.level_token(F.col("text")).alias("level"))


@query("extract_address", f"SELECT page_id, {_address_sql('html')} AS address FROM pages")
def extract_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_table(spark, sf_dir, "pages").select("page_id", T.address_token(F.col("html")).alias("address"))


@query(
    "template_content",
    f"""WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)
    SELECT id, {O.mask("text")} AS templated FROM t""",
)
def template_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.text_table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    p = X.text_table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return d.unionByName(p).select("id", T.template_content(F.col("text")).alias("templated"))


@query(
    "render_template",
    f"""WITH c AS (SELECT c_custkey, c_mktsegment AS component, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_custkey::VARCHAR END AS pid,
      CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE 'balance ' || printf('%.2f', c_acctbal) || ' of #' || c_custkey END AS content FROM customer),
    m AS (SELECT *, {O.mask("content")} AS body FROM c)
    SELECT c_custkey, component || CASE WHEN pid <> '' THEN '[' || pid || ']' ELSE '' END
      || CASE WHEN body <> '' THEN ': ' || body ELSE '' END AS templated FROM m""",
)
def render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    content = F.when(k % 5 == 0, "  ").otherwise(
        F.concat(F.lit("balance "), F.format_string("%.2f", F.col("c_acctbal")), F.lit(" of #"), k)
    )
    pid = F.when(k % 3 == 0, "").otherwise(k.cast("string"))
    return X.table(spark, sf_dir, "customer").select(
        "c_custkey", T.render_templated(F.col("c_mktsegment"), pid, T.template_content(content)).alias("templated")
    )


@query(
    "parse_and_template",
    f"WITH {O.PARSED} SELECT log_id, os, component, pid, content, templated FROM parsed",
)
def parse_and_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("log_id", "os", "component", "pid", "content", "templated")


@query("issue_key", f"WITH {O.PARSED} SELECT issue_key, count(*) AS n FROM parsed GROUP BY issue_key")
def issue_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).groupBy("issue_key").agg(F.count(F.lit(1)).alias("n"))


@query("source_kind", f"WITH {O.LINES} SELECT split_part(source, ':', 1) AS kind, count(*) AS n FROM log_lines GROUP BY 1")
def source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.log_lines(spark, sf_dir).groupBy(T.source_kind(F.col("source")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "embedder_namespace",
    """SELECT page_id, 'logs_linux' || CASE WHEN s = '' THEN '' ELSE '__' || s END AS name FROM (
      SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)""",
)
def embedder_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.text_table(spark, sf_dir, "pages").select("page_id", T.embedder_namespace(F.lit("logs_linux"), F.col("url")).alias("name"))


@query(
    "failure_signals",
    f"""WITH {O.PARSED}, t AS (
      SELECT 'l' || log_id AS id, templated || ' ' || line AS text FROM parsed
      UNION ALL SELECT 'd' || doc_id, text FROM documents),
    s AS (SELECT id, {O.labels("text")} AS ev FROM t)
    SELECT id, len(ev) > 0 AS has_signal, coalesce(ev[1], 'unknown') AS label, least(1.0, 0.2::DOUBLE * len(ev)) AS score,
      array_to_string(ev, ',') AS evidence FROM s""",
)
def failure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = parsed(spark, sf_dir).select(F.concat(F.lit("l"), F.col("log_id")).alias("id"), F.concat_ws(" ", "templated", "line").alias("text"))
    docs = X.text_table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    rows = lines.unionByName(docs).select("id", R.failure_labels(F.col("text")).alias("ev"))
    return rows.select("id", R.signal_from_labels(F.col("ev")).alias("s")).select(
        "id", "s.has_signal", "s.label", "s.score", F.array_join("s.evidence", ",").alias("evidence")
    )


@query(
    "label_counts",
    f"""WITH {O.PARSED}, s AS (SELECT os, {O.labels("templated || ' ' || line")} AS ev FROM parsed)
    SELECT os, coalesce(ev[1], 'unknown') AS label, count(*) AS n FROM s GROUP BY 1, 2""",
)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per OS and failure label: the whole path from raw line to score."""
    return L.with_signals(parsed(spark, sf_dir)).groupBy("os", "label").agg(F.count(F.lit(1)).alias("n"))


@query("issue_sessions", f"WITH {O.PARSED}, {O.sessions('parsed', 'os, issue_key', 120_000_000)} SELECT log_id, os, issue_key, session_us FROM sess")
def issue_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed(spark, sf_dir).select("log_id", "ts", "os", "issue_key")
    return I.issue_sessions(rows).select("log_id", "os", "issue_key", "session_us")


@query(
    "user_sessions",
    f"WITH {O.LINES}, {O.sessions('log_lines', 'user_id', 21_600_000_000)} SELECT user_id, session_us, count(*) AS n FROM sess GROUP BY 1, 2",
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour sessions per user: many rows per key, sessions across bucket borders."""
    rows = X.log_lines(spark, sf_dir).select("log_id", "ts", "user_id")
    return I.issue_sessions(rows, ["user_id"], 21_600).groupBy("user_id", "session_us").agg(F.count(F.lit(1)).alias("n"))


def _issues(spark: SparkSession, sf_dir: str, gap_sec: int = I.INACTIVITY_SEC) -> DataFrame:
    return I.build_issues(parsed(spark, sf_dir), gap_sec=gap_sec)


ISSUE_COLS = "os, issue_key, session_us, last_us, n_logs, templated_summary, log_ids"


def _issue_rows(found: DataFrame) -> DataFrame:
    return found.withColumn("log_ids", F.array_join(F.col("logs")["log_id"].cast("array<string>"), ",")).drop("logs")


@query("issues", f"WITH {O.ISSUES} SELECT {ISSUE_COLS} FROM issues")
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issue_rows(_issues(spark, sf_dir))


@query("issues_day_gap", f"WITH {O.ISSUES.replace('120000000', '86400000000')} SELECT {ISSUE_COLS} FROM issues")
def issues_day_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a gap of one day the unparsed keys form issues far beyond the 50 logs kept."""
    return _issue_rows(_issues(spark, sf_dir, 86_400))


@query(
    "list_incidents",
    f"""WITH {O.ISSUES} SELECT id, os, issue_key, templated_summary, least(n_logs, 50) AS n_logs, ms AS time_ms
    FROM entries ORDER BY ms DESC, id DESC LIMIT 100""",
)
def list_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.list_incidents(I.issue_entries(_issues(spark, sf_dir)))
    return found.withColumn("n_logs", F.size("logs").cast("bigint")).drop("logs")


ASSIGNED_SQL = f"WITH {O.PARSED}, assigned AS (SELECT *, 'c' || (user_id % 20) AS cluster_id FROM parsed)"


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).withColumn("cluster_id", F.concat(F.lit("c"), F.col("user_id") % 20))


@query("cluster_counts", f"{ASSIGNED_SQL} SELECT os, cluster_id, count(*) AS n_logs FROM assigned GROUP BY 1, 2")
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_counts(assigned(spark, sf_dir))


@query(
    "cluster_candidates",
    f"""{ASSIGNED_SQL} SELECT os, cluster_id, log_id, epoch_us(ts) AS us FROM (SELECT *, row_number() OVER (
      PARTITION BY os, cluster_id ORDER BY ts, log_id) AS n FROM assigned) WHERE n = 20""",
)
def cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cluster_candidates(assigned(spark, sf_dir)).withColumn("us", F.unix_micros("ts")).drop("ts")
