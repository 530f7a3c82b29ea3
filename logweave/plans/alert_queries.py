"""Queries over alerts: listing, search, feedback, automations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.functions import results as J, rules as R
from logweave.operators import alerts as A, automations as U, issues as I, search as Q
from logweave.plans import fixtures as X, line_queries as LQ, oracle as O, vector_queries as VQ
from logweave.plans.registry import query
from logweave.session import fresh_path


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alerts_enriched(X.alerts(spark, sf_dir), X.keyed_alerts(spark, sf_dir))


@query("alerts_enriched", f"WITH {O.ALERTS} SELECT id, ms, seq, type, os, issue_key, summary, solution, failure_type FROM enriched")
def alerts_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).drop("result")


TTL_30_DAYS = 30 * 86_400
LIST_SQL = f"""WITH {O.ALERTS}, now AS (SELECT max(ms) AS as_of FROM alerts),
  marked AS (SELECT e.*, p.id IS NOT NULL AS persisted, e.ms >= as_of - {{ttl}} AS recent
    FROM enriched e CROSS JOIN now LEFT JOIN (SELECT DISTINCT id FROM persist_events) p ON p.id = e.id)"""


@query(
    "list_alerts",
    LIST_SQL.format(ttl=TTL_30_DAYS * 1000) + """
    SELECT id, os, issue_key, type, failure_type, persisted, CASE WHEN recent THEN summary END AS summary,
      CASE WHEN recent THEN solution END AS solution FROM marked WHERE recent OR persisted ORDER BY ms DESC, seq DESC LIMIT 1000""",
)
def list_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's alerts, then older persisted ones."""
    rows = X.alerts(spark, sf_dir)
    found = A.list_alerts(rows, X.keyed_alerts(spark, sf_dir), X.persist_events(spark, sf_dir), A.newest_ms(rows), 1000, TTL_30_DAYS)
    return found.select("id", "os", "issue_key", "type", "failure_type", "persisted", "summary", "solution")


@query(
    "alerts_within_ttl",
    LIST_SQL.format(ttl=365 * 86_400_000) + " SELECT id, persisted FROM marked WHERE recent OR persisted",
)
def alerts_within_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alerts(spark, sf_dir).select("id", "ms")
    marks = A.persist_marks(X.persist_events(spark, sf_dir)).select("id", F.lit(True).alias("persisted"))
    flagged = rows.join(marks, "id", "left").withColumn("persisted", F.coalesce("persisted", F.lit(False)))
    return A.within_ttl(flagged, A.newest_ms(rows), 365 * 86_400).select("id", "persisted")


@query(
    "persisted_alerts",
    f"""WITH {O.ALERTS}, marks AS (SELECT id, min(ts) AS persisted_at FROM persist_events GROUP BY id)
    SELECT a.id, m.persisted_at, coalesce(k.summary, a.summary) AS summary, k.id IS NULL AS rebuilt
    FROM marks m JOIN alerts a ON a.id = m.id LEFT JOIN keyed k ON k.id = m.id""",
)
def persisted_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.persisted_alerts(X.persist_events(spark, sf_dir), X.alerts(spark, sf_dir), X.keyed_alerts(spark, sf_dir))
    return found.select("id", "persisted_at", "summary", "rebuilt")


@query("feedback_latest", f"WITH {O.ALERTS} SELECT id, feedback FROM feedback")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.feedback_latest(X.feedback_events(spark, sf_dir))


@query(
    "parse_result",
    f"""WITH {O.ALERTS} SELECT id, r_type AS failure_type, r_summary AS summary,
      CASE WHEN readable THEN NULL ELSE 'no answer' END AS raw FROM alerts""",
)
def parse_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alerts(spark, sf_dir).withColumn("_r", J.parse_result(F.col("result")))
    return rows.select(
        "id", J.result_text(F.col("_r"), "failure_type").alias("failure_type"), J.result_text(F.col("_r"), "summary").alias("summary"),
        J.get(F.col("_r"), "$.raw", "string").alias("raw"),
    )


@query(
    "parse_query_list",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN '' WHEN 2 THEN c_name || ';1;2'
      ELSE c_name || ';' || c_mktsegment || ';third' END AS queries FROM customer""",
)
def parse_query_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    four = F.array("c_name", "c_mktsegment", F.lit("third"), F.lit("fourth"))
    answer = (
        F.when(k % 4 == 3, "no json at all")
        .when(k % 4 == 2, F.concat(F.lit('["'), F.col("c_name"), F.lit('", 1, 2, 3]')))
        .when(k % 4 == 1, F.to_json(four))
        .otherwise(F.to_json(F.struct(four.alias("queries"))))
    )
    rows = X.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.array_join(J.parse_query_list(answer), ";").alias("queries"))


@query(
    "alert_from_result",
    f"""WITH {O.ALERTS} SELECT id, 'issue' AS type, readable AND r_type <> 'application' AS is_hardware_failure, r_type AS failure_type,
      CASE WHEN readable THEN conf::DOUBLE END AS confidence FROM alerts""",
)
def alert_from_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = X.alerts(spark, sf_dir).select("id", "os", "issue_key", "result")
    found = A.alert_from_result(candidates)
    return found.select("id", "type", "is_hardware_failure", "failure_type", F.col("confidence").try_cast("double").alias("confidence"))


@query("alerts_sink", f"WITH {O.ALERTS} SELECT os, count(*) AS n, max(ms + 86400000) AS expires_ms FROM alerts GROUP BY os")
def alerts_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written to the alert table and read back."""
    path = fresh_path(spark, "alerts")
    A.write_alerts(X.alerts(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("os").agg(F.count(F.lit(1)).alias("n"), F.max("expires_ms").alias("expires_ms"))


SEVERITY_SQL = """CASE WHEN regexp_matches(lower({0}), 'power|raid|storage') THEN 'critical'
  WHEN regexp_matches(lower({0}), 'disk|nvme|filesystem|cpu|memory|network|thermal') THEN 'warning' ELSE 'info' END"""


@query("derive_severity", f"WITH {O.ALERTS} SELECT id, {SEVERITY_SQL.format('r_type')} AS severity FROM alerts")
def derive_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.alerts(spark, sf_dir).withColumn("_r", J.parse_result(F.col("result")))
    return rows.select("id", R.derive_severity(J.result_text(F.col("_r"), "failure_type")).alias("severity"))


@query(
    "search_alerts_structured",
    LIST_SQL.format(ttl=TTL_30_DAYS * 1000) + f"""
    SELECT id, os, summary, {SEVERITY_SQL.format('failure_type')} AS severity FROM marked
    WHERE (recent OR persisted) AND {SEVERITY_SQL.format('failure_type')} = 'critical' AND lower(os) = 'linux' AND contains(lower(failure_type), 'sto')
    ORDER BY ms DESC, seq DESC LIMIT 5""",
)
def search_alerts_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = X.alerts(spark, sf_dir)
    rows = A.list_alerts(stream, X.keyed_alerts(spark, sf_dir), X.persist_events(spark, sf_dir), A.newest_ms(stream), None, TTL_30_DAYS)
    found = Q.search_alerts_structured(rows, "Critical", "LINUX", "Sto")
    return found.select("id", "os", "summary", "severity")


TEXTS = ("disk trouble of customer", "Check STORAGE unit now", "stream summary")
INCIDENT_TEXTS = ("link down on port", "I/O ERROR on windows", "httpd failed")


def _relevance_sql(text: str, queries: tuple[str, ...]) -> str:
    parts = []
    for q in queries:
        low = q.lower()
        parts.append(f"CASE WHEN contains({text}, '{low}') THEN 1.0::DOUBLE ELSE 0 END")
        parts += [f"CASE WHEN contains({text}, '{w}') THEN 0.5::DOUBLE ELSE 0 END" for w in low.split() if len(w) > 3]
    return " + ".join(parts)


ALERT_HITS = f"""
strict_alerts AS (SELECT * REPLACE (coalesce(nullif(summary, ''), r_summary) AS summary, coalesce(nullif(solution, ''), r_recommendation) AS solution) FROM alerts WHERE strict),
alert_texts AS (SELECT *, lower(summary || ' ' || solution || ' ' || r_type || ' ' || os) AS text FROM strict_alerts),
alert_scores AS (SELECT *, {_relevance_sql('text', TEXTS)} AS relevance FROM alert_texts),
alert_hits AS (SELECT * FROM alert_scores WHERE relevance > 0 ORDER BY relevance DESC, ms DESC, seq DESC LIMIT 10)"""
INCIDENT_HITS = f"""
issue_texts AS (SELECT *, lower(templated_summary || ' ' || os || ' ' || issue_key) AS text FROM entries),
issue_scores AS (SELECT *, {_relevance_sql('text', INCIDENT_TEXTS)} AS relevance FROM issue_texts),
incident_hits AS (SELECT * FROM issue_scores WHERE relevance > 0 ORDER BY relevance DESC, ms DESC, id DESC LIMIT 10)"""


@query("search_alerts", f"WITH {O.ALERTS}, {ALERT_HITS} SELECT id, os, summary, relevance FROM alert_hits")
def search_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search_alerts(X.alerts(spark, sf_dir), TEXTS).select("id", "os", "summary", "relevance")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as they are searched: by their summaries, without their logs."""
    return I.issue_entries(I.build_issues(LQ.parsed(spark, sf_dir), with_logs=False))


@query(
    "search_incidents",
    f"""WITH {O.ISSUES}, {INCIDENT_HITS} SELECT id, os, issue_key, substr(templated_summary, 1, 500) AS templated_summary, relevance
    FROM incident_hits""",
)
def search_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.search_incidents(entries(spark, sf_dir), INCIDENT_TEXTS)
    return found.select("id", "os", "issue_key", "templated_summary", "relevance")


@query(
    "search_sources",
    f"""WITH {O.ALERTS}, {O.ISSUES}, {ALERT_HITS}, {INCIDENT_HITS},
    tpl AS ({VQ.SEARCH_TEMPLATES_SQL})
    SELECT * FROM (SELECT 'alert' AS type, id, os, summary, relevance, NULL AS document, NULL::DOUBLE AS distance FROM alert_hits ORDER BY relevance DESC, ms DESC, seq DESC LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'incident', id, os, substr(templated_summary, 1, 200), relevance, NULL, NULL FROM incident_hits ORDER BY relevance DESC, ms DESC, id DESC LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'log', NULL, os, NULL, NULL, substr(document, 1, 200), distance FROM tpl ORDER BY distance, document LIMIT 5)""",
)
def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = Q.search_alerts(X.alerts(spark, sf_dir), TEXTS)
    incidents = Q.search_incidents(entries(spark, sf_dir), INCIDENT_TEXTS)
    return Q.search_sources(alerts, incidents, VQ.search_templates(spark, sf_dir))


RULES_SQL = """
rules(position, rule_id, provider, m_type, m_conf, cooldown_ms) AS (VALUES
  (0, 'swap_shelf', 'ansible_tower', 'storage', 0.75, 2700000::BIGINT),
  (1, 'call_facility', 'servicenow', 'power', 0.6, 3600000::BIGINT),
  (2, 'any_trouble', 'terraform_cloud', '', 0.3, 15552000000::BIGINT),
  (3, 'page_someone', 'pager', 'network', 0.0, 900000::BIGINT)),
judged AS (
  SELECT *, coalesce(nullif(failure_type, ''), CASE WHEN strict THEN r_type END, 'None') AS m,
    CASE WHEN confidence <> '' OR strict THEN conf ELSE 0.0 END AS c FROM alerts),
matches AS (
  SELECT a.*, r.rule_id, r.position, r.provider, r.cooldown_ms FROM judged a JOIN rules r
    ON (r.m_type = '' OR r.m_type = a.m) AND a.c >= r.m_conf),
per_time AS (SELECT rule_id, issue_key, ms, cooldown_ms, min(seq) AS seq FROM matches GROUP BY ALL),
linked AS (
  SELECT a.rule_id, a.issue_key, a.ms, a.seq, min(b.ms) AS next_ms FROM per_time a LEFT JOIN per_time b
    ON a.rule_id = b.rule_id AND a.issue_key = b.issue_key AND b.ms >= a.ms + a.cooldown_ms GROUP BY ALL),
fires AS (
  SELECT f.rule_id, f.issue_key, f.ms, f.seq, f.next_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id, issue_key ORDER BY ms) AS n FROM linked) f WHERE f.n = 1
  UNION ALL
  SELECT l.rule_id, l.issue_key, l.ms, l.seq, l.next_ms FROM fires f JOIN linked l
    ON l.rule_id = f.rule_id AND l.issue_key = f.issue_key AND l.ms = f.next_ms),
fired AS (SELECT m.* FROM matches m JOIN fires f ON f.rule_id = m.rule_id AND f.issue_key = m.issue_key AND f.ms = m.ms AND f.seq = m.seq)"""


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.match_automations(X.alerts(spark, sf_dir), X.RULES)


@query("match_automations", f"WITH RECURSIVE {O.ALERTS}, {RULES_SQL} SELECT id, rule_id, position, provider FROM matches")
def match_automations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("id", "rule_id", "position", "provider")


@query(
    "render_action",
    f"""WITH RECURSIVE {O.ALERTS}, {RULES_SQL} SELECT id, rule_id, CASE rule_id
      WHEN 'swap_shelf' THEN 'case=' || id || ';where=' || os || '/' || issue_key
      WHEN 'call_facility' THEN 'subject=' || os || ' lost power (' || failure_type || ');certainty=' || confidence || ';desk=site'
      WHEN 'any_trouble' THEN 'message=' || CASE WHEN strict THEN r_summary ELSE '{{{{ alert.result.summary }}}}' END || ' {{{{ alert.result.missing }}}}'
      ELSE '' END AS params FROM matches""",
)
def render_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return matches(spark, sf_dir).select("id", "rule_id", F.array_join(pairs, ";").alias("params"))


@query(
    "parse_cooldown",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN c_custkey * 60 WHEN 1 THEN c_custkey * 3600 WHEN 2 THEN c_custkey WHEN 3 THEN c_custkey
      ELSE 900 END AS sec FROM customer""",
)
def parse_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = (
        F.when(k % 7 == 0, F.concat(k, F.lit("m"))).when(k % 7 == 1, F.concat(k, F.lit("H"))).when(k % 7 == 2, F.concat(k, F.lit("s")))
        .when(k % 7 == 3, F.concat(k, F.lit("0"))).when(k % 7 == 4, "x").when(k % 7 == 5, "")
    )
    return X.table(spark, sf_dir, "customer").select("c_custkey", R.parse_cooldown(text).alias("sec"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cooldown_fires(matches(spark, sf_dir))


@query("cooldown_fires", f"WITH RECURSIVE {O.ALERTS}, {RULES_SQL} SELECT rule_id, id, issue_key, ms, seq FROM fired")
def cooldown_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires(spark, sf_dir).select("rule_id", "id", "issue_key", "ms", "seq")


@query(
    "automation_actions",
    f"WITH RECURSIVE {O.ALERTS}, {RULES_SQL} SELECT rule_id, provider, id AS alert_id, ms, true AS dry_run FROM fired WHERE provider <> 'pager'",
)
def automation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.actions(fires(spark, sf_dir)).select("rule_id", "provider", "alert_id", "ms", "dry_run")


@query(
    "automation_stats",
    f"""WITH RECURSIVE {O.ALERTS}, {RULES_SQL} SELECT provider, count(*) AS triggered, max(ms) AS last_ms FROM fired
    WHERE provider <> 'pager' GROUP BY ROLLUP (provider)""",
)
def automation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.automation_stats(U.actions(fires(spark, sf_dir)))
