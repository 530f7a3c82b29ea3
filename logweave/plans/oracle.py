"""The derivations of ``fixtures.py`` as SQL common table expressions."""

from __future__ import annotations

from logweave.functions import text as T
from logweave.functions.rules import FAILURE_RULES

LINES = """
lines0 AS (
  SELECT *, CASE event_type
      WHEN 'error' THEN 'I/O error on 10.0.0.' || user_id || ' sector #' || event_id
      WHEN 'click' THEN 'link down on port 0x' || user_id || ' code ' || (event_id % 7)
      WHEN 'purchase' THEN 'service httpd failed to start version 1.2.' || (event_id % 10)
      WHEN 'view' THEN 'temperature limit at 12:30:45 value -' || CAST(round(value * 100) AS BIGINT)
      ELSE 'session opened id=' || event_id END AS body
  FROM events),
log_lines AS (
  SELECT event_id AS log_id, ts, user_id, event_type, value,
    CASE event_id % 4 WHEN 0 THEN 'Linux.log' WHEN 1 THEN 'Mac.log' WHEN 2 THEN 'Windows_2k.log'
      ELSE 'app:' || event_type END AS source,
    CASE WHEN event_id % 4 = 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ', Info  CBS    ' || body
      ELSE strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 5) || ' ' || event_type
        || CASE WHEN event_id % 17 = 0 THEN '' ELSE '[' || user_id || ']' END || ': ' || body END AS line
  FROM lines0)"""


def mask(expr: str) -> str:
    """Masking without lookbehind: word borders become a control character first."""
    for pattern, repl in T.MASKS[:-1]:
        expr = f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"
    expr = f"regexp_replace({expr}, '\\b', chr(1), 'g')"
    expr = f"regexp_replace({expr}, '(^|[^\\x01])[-+]\\x01\\d+\\x01(\\.\\x01\\d+\\x01)?', '\\1<*>', 'g')"
    expr = f"regexp_replace({expr}, '\\x01\\d+\\x01(\\.\\x01\\d+\\x01)?', '<*>', 'g')"
    return f"trim(regexp_replace(replace({expr}, chr(1), ''), '\\s+', ' ', 'g'))"


PARSED = LINES + f""",
routed AS (
  SELECT *, CASE WHEN contains(lower(source), 'linux.log') THEN 'linux'
      WHEN contains(lower(source), 'mac.log') THEN 'macos'
      WHEN contains(lower(source), 'windows') THEN 'windows' ELSE 'unknown' END AS os
  FROM log_lines),
matched AS (
  SELECT *, os IN ('linux', 'macos') AND regexp_matches(line, '{T.SYSLOG_PATTERN}') AS ok,
    regexp_extract(line, '{T.SYSLOG_PATTERN}',
      ['month', 'date', 'time', 'host', 'component', 'pid', 'content']) AS p
  FROM routed),
parts AS (
  SELECT *, CASE WHEN ok THEN trim(p.component) ELSE 'unknown' END AS component,
    CASE WHEN ok THEN p.pid ELSE '' END AS pid,
    CASE WHEN ok THEN p.content ELSE line END AS content
  FROM matched),
masked AS (SELECT *, {mask("content")} AS body_masked FROM parts),
parsed AS (
  SELECT *, component || CASE WHEN pid <> '' THEN '[' || pid || ']' ELSE '' END
      || CASE WHEN body_masked <> '' THEN ': ' || body_masked ELSE '' END AS templated,
    os || '|' || lower(component) || '|' || CASE WHEN pid = '' THEN 'nopid' ELSE pid END AS issue_key
  FROM masked)"""


def labels(expr: str) -> str:
    """List of the failure labels of a text, in rule order."""
    hits = ", ".join(
        f"CASE WHEN regexp_matches({expr}, '(?i){pattern}') THEN '{name}' END" for name, pattern in FAILURE_RULES
    )
    return f"[x for x in [{hits}] if x IS NOT NULL]"


def sessions(source: str, keys: str, gap_us: int) -> str:
    """CTE ``sess``: rows of ``source`` with session_us."""
    return f"""
gaps AS (
  SELECT *, epoch_us(ts) AS us,
    lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts, log_id) AS prev_us FROM {source}),
sess AS (
  SELECT *, max(CASE WHEN prev_us IS NULL OR us - prev_us >= {gap_us} THEN us END)
    OVER (PARTITION BY {keys} ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) AS session_us FROM gaps)"""


VECTORS = """
vectors AS (
  SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'macos' ELSE 'windows' END AS os,
    CAST(embedding AS DOUBLE[]) AS raw, label,
    CASE WHEN vec_id % 10 = 0 THEN 'known' ELSE 'log' END AS role FROM embeddings),
units AS (
  SELECT *, [x / sqrt(list_inner_product(raw, raw)) for x in raw] AS v FROM vectors),
known AS (SELECT *, 'c' || lpad(vec_id::VARCHAR, 9, '0') AS cluster_id FROM units WHERE role = 'known'),
logs AS (SELECT * FROM units WHERE role = 'log')"""


def distance(a: str, b: str) -> str:
    return f"round(1.0 - greatest(-1.0, least(1.0, list_inner_product({a}, {b}))), 6)"


ALERTS = """
a0 AS (
  SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'power' WHEN '2-HIGH' THEN 'storage'
      WHEN '3-MEDIUM' THEN 'disk' WHEN '4-NOT SPECIFIED' THEN 'application' ELSE 'network' END AS ft,
    (CAST(round(o_totalprice * 100) AS BIGINT) % 101) / 100.0 AS conf,
    epoch_ms(o_orderdate) AS ms, o_orderkey AS seq,
    CASE o_custkey % 4 WHEN 0 THEN 'linux' WHEN 1 THEN 'macos' WHEN 2 THEN 'windows' ELSE 'unknown' END AS os
  FROM orders),
alerts AS (
  SELECT ms || '-' || seq AS id, ms, seq, CASE WHEN seq % 5 = 0 THEN 'cluster' ELSE 'issue' END AS type,
    os, os || '|cust|' || o_custkey AS issue_key, o_custkey, conf,
    CASE WHEN seq % 5 = 0 THEN 'k' || (o_custkey % 10) END AS cluster_id,
    CASE WHEN seq % 4 = 3 THEN '' ELSE ft END AS failure_type,
    CASE WHEN seq % 4 = 2 THEN '' ELSE printf('%.2f', conf) END AS confidence,
    CASE WHEN seq % 2 = 0 THEN 'stream summary ' || seq ELSE '' END AS summary,
    '' AS solution,
    seq % 9 <> 5 AS readable,
    seq % 9 NOT IN (4, 5) AS strict,
    CASE WHEN seq % 9 <> 5 THEN ft ELSE '' END AS r_type,
    CASE WHEN seq % 9 <> 5 THEN ft || ' trouble of customer ' || o_custkey ELSE '' END AS r_summary,
    CASE WHEN seq % 9 <> 5 THEN 'check ' || ft || ' unit' ELSE '' END AS r_recommendation
  FROM a0),
keyed AS (
  SELECT * REPLACE (
    CASE WHEN seq % 3 = 1 THEN 'keyed summary ' || seq ELSE '' END AS summary,
    CASE WHEN seq % 6 = 1 THEN 'replace the part' ELSE '' END AS solution)
  FROM alerts WHERE seq % 3 <> 0),
enriched AS (
  SELECT a.id, a.ms, a.seq, a.type, a.os, a.issue_key, a.o_custkey, a.r_type AS failure_type,
    coalesce(nullif(CASE WHEN k.id IS NOT NULL THEN k.summary ELSE a.summary END, ''), a.r_summary) AS summary,
    coalesce(nullif(CASE WHEN k.id IS NOT NULL THEN k.solution ELSE a.solution END, ''), a.r_recommendation) AS solution
  FROM alerts a LEFT JOIN keyed k ON a.id = k.id),
persist_events AS (
  SELECT id, ms + 1000 AS ts FROM alerts WHERE seq % 10 = 0
  UNION ALL SELECT id, ms + 60000 FROM alerts WHERE seq % 20 = 0),
feedback_events AS (
  SELECT id, CASE WHEN seq % 7 = 0 THEN 'correct' ELSE 'incorrect' END AS feedback, ms AS ts
  FROM alerts WHERE seq % 7 IN (0, 1)
  UNION ALL SELECT id, CASE WHEN seq % 7 = 0 THEN 'incorrect' ELSE 'correct' END, ms + 5000
  FROM alerts WHERE seq % 7 IN (0, 1) AND seq % 3 = 0),
feedback AS (SELECT id, max_by(feedback, ts) AS feedback FROM feedback_events GROUP BY id)"""

AGENT_METRICS = LINES + """,
agent_metrics AS (
  SELECT log_id AS event_id, ts, log_id // 10 AS batch_id, 'host' || (user_id % 5) AS host,
    'sd' || (user_id % 3) AS device, '/data' AS path,
    CASE event_type WHEN 'error' THEN ' MacOS_log ' WHEN 'view' THEN 'cpu_temperature'
      WHEN 'purchase' THEN 'disk' WHEN 'click' THEN 'smart_device' ELSE 'Queue_Len' END AS name,
    CASE WHEN event_type = 'error' AND log_id % 11 <> 0 THEN line END AS message,
    CASE WHEN event_type IN ('view', 'signup') AND log_id % 11 <> 0 THEN round(value, 2) END AS value,
    CASE WHEN event_type = 'purchase' THEN round(value, 2) END AS used_percent,
    CASE WHEN event_type = 'click' THEN log_id END AS power_on_hours,
    CASE WHEN event_type = 'click' THEN CASE WHEN log_id % 3 = 0 THEN 0.0 ELSE 1.0 END END AS health_ok,
    CASE WHEN log_id % 13 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 ELSE epoch_us(ts) * 1000 END AS nano
  FROM log_lines),
agents AS (
  SELECT n_nationkey + 1 AS id, n_name AS name, n_nationkey % 4 <> 3 AS enabled,
    'tok' || (n_nationkey % 10) AS token,
    CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'a' || (n_nationkey % 2) END AS agent_id,
    n_nationkey % 5 = 0 AS has_list FROM nation),
batches AS (
  SELECT batch_id, max(ts) AS ts, count(*) AS n,
    CASE WHEN batch_id % 12 = 11 THEN '' ELSE 'tok' || (batch_id % 12) END AS token,
    CASE WHEN batch_id % 3 = 0 THEN NULL ELSE 'a' || (batch_id % 2) END AS agent_id,
    bool_or(host IN ('host0', 'host1')) AS on_list
  FROM agent_metrics GROUP BY batch_id),
fitting AS (
  SELECT b.batch_id, min(a.id) AS id FROM batches b JOIN agents a ON a.enabled AND a.token = b.token
    AND (a.agent_id = '' OR coalesce(b.agent_id, '') = '' OR a.agent_id = b.agent_id) GROUP BY b.batch_id),
admitted AS (
  SELECT b.*, a.id AS source_id, a.name AS agent_name,
    CASE WHEN b.token = '' THEN 'missing token' WHEN a.id IS NULL THEN 'unknown token'
      WHEN a.has_list AND NOT b.on_list THEN 'host not allowed' ELSE '' END AS reason
  FROM batches b LEFT JOIN fitting f ON b.batch_id = f.batch_id LEFT JOIN agents a ON a.id = f.id),
routed_metrics AS (
  SELECT m.*, a.source_id, m.event_id - min(m.event_id) OVER (PARTITION BY m.batch_id) AS pos,
    message IS NOT NULL AS is_log
  FROM agent_metrics m JOIN admitted a ON m.batch_id = a.batch_id WHERE a.reason = '')"""

AGENT_POINTS = AGENT_METRICS + """,
agent_points AS (
  SELECT event_id AS log_id, 0 AS point_no, 'system.cpu.temperature' AS name, value, 'C' AS unit, nano, host, '' AS attribute
  FROM agent_metrics WHERE name = 'cpu_temperature' AND value IS NOT NULL
  UNION ALL SELECT event_id, 0, 'smart.health_ok', health_ok, NULL, nano, host, 'device=' || device
  FROM agent_metrics WHERE name = 'smart_device'
  UNION ALL SELECT event_id, 1, 'smart.power_on_hours', power_on_hours::DOUBLE, 'h', nano, host, 'device=' || device
  FROM agent_metrics WHERE name = 'smart_device'
  UNION ALL SELECT event_id, 0, 'fs.used_percent', used_percent, '%', nano, host, 'path=' || path
  FROM agent_metrics WHERE name = 'disk'
  UNION ALL SELECT event_id, 0, 'telegraf.queue_len', value, NULL, nano, host, ''
  FROM agent_metrics WHERE name = 'Queue_Len' AND value IS NOT NULL)"""

SNMP = """
readings AS (
  SELECT p_partkey AS log_id, 'sw' || (p_partkey % 7) AS host, '1.3.6.1.' || (p_partkey % 20) AS oid,
    CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS value,
    p_partkey % 30 + 1 AS source_id, (1704067200 + p_partkey)::BIGINT * 1000000000 AS nano FROM part),
snmp_points AS (
  SELECT r.*, 'port.speed.' || (log_id % 20) AS name,
    CASE WHEN (log_id % 20) % 4 = 0 THEN value * 0.01 ELSE value END AS scaled
  FROM readings r JOIN nation n ON n.n_nationkey + 1 = r.source_id
  WHERE (log_id % 20) % 2 = 0 AND value IS NOT NULL)"""

SENSORS = """
sensors AS (
  SELECT *, s_nationkey::BIGINT * 1000000 + s_suppkey // 250 AS log_id,
    row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 250 ORDER BY s_suppkey) - 1 AS pos,
    (1704067200 + s_nationkey)::BIGINT * 1000000000 AS nano,
    CASE WHEN s_suppkey % 9 IN (0, 1) THEN NULL ELSE round(s_acctbal, 2) END AS reading FROM supplier)"""

ISSUES = PARSED + "," + sessions("parsed", "os, issue_key", 120_000_000) + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY os, issue_key, session_us ORDER BY ts, log_id) AS rn FROM sess),
issues AS (
  SELECT os, issue_key, session_us, max(us) AS last_us, count(*) AS n_logs,
    string_agg(CASE WHEN rn <= 50 THEN templated END, chr(32) || chr(10) ORDER BY rn) AS templated_summary,
    string_agg(CASE WHEN rn <= 50 THEN log_id::VARCHAR END, ',' ORDER BY rn) AS log_ids
  FROM ranked GROUP BY os, issue_key, session_us),
entries AS (
  SELECT *, (last_us + 120000000) // 1000 AS ms,
    (last_us + 120000000) // 1000 || '-' || substr(sha1(os || '|' || issue_key || '|' || session_us), 1, 12) AS id
  FROM issues)"""


def text_vectors(source: str, keys: str, text: str, out: str) -> str:
    """CTE ``out``: rows of ``source`` with ``v``, the unit vector of hashed token counts of ``text``; ``keys`` name a row."""
    return f"""
{out}_tok AS (SELECT {keys}, unnest(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS t FROM {source}),
{out}_cnt AS (SELECT {keys}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS d, count(*)::DOUBLE AS c FROM {out}_tok GROUP BY ALL),
{out}_map AS (SELECT {keys}, sqrt(sum(c * c)) AS len, list(d) AS ds, list(c) AS cs FROM {out}_cnt GROUP BY ALL),
{out} AS (SELECT s.*, [coalesce(m.cs[list_position(m.ds, x)], 0.0) / coalesce(m.len, 1.0) for x in range(64)] AS v FROM {source} s LEFT JOIN {out}_map m USING ({keys}))"""


def first_seeds(rows: str, pairs: str, threshold: float, name: str) -> str:
    """CTE ``name`` (os, n): numbered rows (os, n) that have no earlier seed of their OS within the threshold, by ``pairs`` (os, a, b, distance)."""
    return f"""
{name}_nb AS MATERIALIZED (SELECT r.os, r.n, list(p.a) FILTER (WHERE p.a IS NOT NULL) AS earlier FROM {rows} r
  LEFT JOIN {pairs} p ON p.os = r.os AND p.b = r.n AND p.a < p.b AND p.distance <= {threshold} GROUP BY r.os, r.n),
{name}_walk AS (SELECT DISTINCT os, 0::BIGINT AS n, []::BIGINT[] AS seeds FROM {name}_nb UNION ALL
  SELECT w.os, w.n + 1, CASE WHEN list_has_any(w.seeds, coalesce(b.earlier, []::BIGINT[])) THEN w.seeds ELSE list_append(w.seeds, w.n + 1) END
  FROM {name}_walk w JOIN {name}_nb b ON b.os = w.os AND b.n = w.n + 1),
{name} AS MATERIALIZED (SELECT os, unnest(arg_max(seeds, n)) AS n FROM {name}_walk GROUP BY os)"""


def close_pairs(rows: str, name: str) -> str:
    """CTE ``name`` (os, a, b, distance): pairs of numbered rows (os, n, v) with a common dimension, a row with itself included."""
    return f"""
{name}_x AS MATERIALIZED (SELECT * FROM (SELECT os, n, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {rows}) WHERE x <> 0),
{name} AS MATERIALIZED (SELECT a.os, a.n AS a, b.n AS b, round(1.0 - greatest(-1.0, least(1.0, sum(a.x * b.x))), 6) AS distance
  FROM {name}_x a JOIN {name}_x b ON a.os = b.os AND a.pos = b.pos GROUP BY a.os, a.n, b.n HAVING distance <= 0.25)"""


#: Masked lines, the prototypes of their clusters, and the cluster of every masked line.
TEXT_CLUSTERS = PARSED + """,
texts AS MATERIALIZED (SELECT os, templated, min(log_id) AS first_log FROM parsed GROUP BY os, templated),""" + text_vectors("texts", "os, templated", "templated", "tv") + """,
ranked_texts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY os ORDER BY first_log) AS n FROM tv),""" + close_pairs("ranked_texts", "near_pair") + "," + first_seeds("ranked_texts", "near_pair", 0.2, "seed") + f""",
joined AS (SELECT t.os, t.first_log, t.templated, t.v, s.first_log::VARCHAR AS cluster,
    row_number() OVER (PARTITION BY t.os, t.n ORDER BY p.distance, s.first_log::VARCHAR) AS r
  FROM ranked_texts t JOIN near_pair p ON p.os = t.os AND p.b = t.n JOIN seed d ON d.os = t.os AND d.n = p.a JOIN ranked_texts s ON s.os = d.os AND s.n = d.n),
members AS (SELECT *, count(*) OVER (PARTITION BY os, cluster) AS size FROM joined WHERE r = 1),
kept AS (SELECT * FROM members WHERE size >= 5),
spread_members AS (SELECT os, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept),
mean_members AS (SELECT os, cluster, pos, avg(x) AS m FROM spread_members GROUP BY ALL),
list_members AS (SELECT os, cluster, list(m ORDER BY pos) AS mean FROM mean_members GROUP BY ALL),
text_protos AS MATERIALIZED (SELECT os, 'cluster_' || cluster AS cluster_id, [x / sqrt(list_inner_product(mean, mean)) for x in mean] AS centroid FROM list_members),
to_protos AS MATERIALIZED (SELECT t.os, t.templated, p.cluster_id, {distance('t.v', 'p.centroid')} AS distance FROM ranked_texts t JOIN text_protos p ON p.os = t.os),
near_texts AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY os, templated ORDER BY distance, cluster_id) AS r FROM to_protos) WHERE r = 1 AND distance <= 0.25),
open_texts AS MATERIALIZED (SELECT t.os, t.templated, t.v, 'cluster_' || sha1(t.os || '|' || t.templated) AS own_id, row_number() OVER (PARTITION BY t.os ORDER BY t.first_log) AS n
  FROM ranked_texts t LEFT JOIN near_texts c USING (os, templated) WHERE c.cluster_id IS NULL),""" + close_pairs("open_texts", "open_pair") + "," + first_seeds("open_texts", "open_pair", 0.25, "online") + """,
own_texts AS (SELECT * FROM (SELECT t.os, t.templated, s.own_id AS cluster_id, p.distance,
    row_number() OVER (PARTITION BY t.os, t.n ORDER BY p.distance, s.own_id) AS r
  FROM open_texts t JOIN open_pair p ON p.os = t.os AND p.b = t.n JOIN online o ON o.os = t.os AND o.n = p.a JOIN open_texts s ON s.os = o.os AND s.n = o.n) WHERE r = 1),
text_clusters AS (SELECT os, templated, cluster_id, distance FROM near_texts UNION ALL SELECT os, templated, cluster_id, distance FROM own_texts)"""

#: What a classification of clusters that reached twenty logs sees: the medoid, then the ten logs nearest to it; the majority label wins.
CLUSTER_RESULTS = TEXT_CLUSTERS + f""",
cand AS (SELECT os, cluster_id FROM parsed JOIN text_clusters USING (os, templated) GROUP BY os, cluster_id HAVING count(*) >= 20),
med AS (SELECT os, cluster_id, templated AS medoid FROM (SELECT k.os, p.cluster_id, k.templated,
      row_number() OVER (PARTITION BY k.os, k.cluster ORDER BY {distance('k.v', 'p.centroid')}, k.first_log::VARCHAR) AS r
    FROM kept k JOIN text_protos p ON p.os = k.os AND p.cluster_id = 'cluster_' || k.cluster) WHERE r = 1
  UNION ALL SELECT os, own_id, templated FROM open_texts JOIN online USING (os, n)),
shown AS MATERIALIZED (SELECT c.os, c.cluster_id, coalesce(med.medoid, '') AS medoid_document, t.v FROM cand c LEFT JOIN med USING (os, cluster_id) LEFT JOIN tv t ON t.os = c.os AND t.templated = med.medoid),
apart AS MATERIALIZED (SELECT s.os, s.cluster_id, t.templated, {distance('s.v', 't.v')} AS distance
  FROM shown s JOIN text_clusters c ON c.os = s.os AND c.cluster_id = s.cluster_id JOIN tv t ON t.os = c.os AND t.templated = c.templated),
found AS (SELECT a.os, a.cluster_id, p.templated AS text, row_number() OVER (PARTITION BY a.os, a.cluster_id ORDER BY a.distance, p.log_id) AS rank
  FROM apart a JOIN parsed p ON p.os = a.os AND p.templated = a.templated),
seen AS (SELECT os, cluster_id, 0 AS rank, medoid_document AS text FROM shown UNION ALL SELECT os, cluster_id, rank, text FROM found WHERE rank <= 10),
judged AS (SELECT os, cluster_id, rank, {labels('text')} AS ev FROM seen),
votes AS (SELECT os, cluster_id, ev[1] AS label, count(*) AS n, min(rank) AS first FROM judged WHERE len(ev) > 0 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY os, cluster_id ORDER BY n DESC, first) AS r FROM votes),
cluster_results AS (SELECT s.os, s.cluster_id, s.medoid_document, coalesce(b.label, 'unknown') AS failure_type
  FROM shown s LEFT JOIN best b ON b.os = s.os AND b.cluster_id = s.cluster_id AND b.r = 1)"""
