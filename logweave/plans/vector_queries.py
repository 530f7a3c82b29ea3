"""Queries over vectors: neighbours, clustering, prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweave.functions import vectors as V
from logweave.operators import alerts as A, clustering as C, embedding as B, enrichment as N, issues as I, knn as K, logs as L, search as Q
from logweave.plans import fixtures as X, line_queries as LQ, oracle as O
from logweave.plans.registry import query
from logweave.session import checkpointed

# The vectors are random, so the default thresholds would match nothing.
WIDE_THRESHOLD = 0.8


def _nearest_sql(query_side: str, items: str, q_id: str, i_id: str, k: int, extra: str = "") -> str:
    return f"""SELECT {q_id} AS q, {i_id} AS i, os, distance, rank FROM (
      SELECT q.{q_id}, i.{i_id}, q.os, {O.distance('q.v', 'i.v')} AS distance,
        row_number() OVER (PARTITION BY q.{q_id} ORDER BY {O.distance('q.v', 'i.v')}, i.{i_id}) AS rank
      FROM {query_side} q JOIN {items} i ON q.os = i.os {extra}) WHERE rank <= {k}"""


def _proto_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.prototypes(spark, sf_dir).select("os", "cluster_id", "label", F.col("centroid").alias("embedding"))


@query(
    "nearest_prototype",
    f"""WITH {O.VECTORS}, n AS ({_nearest_sql('logs', 'known', 'vec_id', 'cluster_id', 3)})
    SELECT q AS log_id, os, i AS cluster_id, distance, CAST(rank AS INTEGER) AS rank FROM n""",
)
def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nearest(X.vector_logs(spark, sf_dir), _proto_items(spark, sf_dir), 3, "log_id", "cluster_id")


@query(
    "nearest_prototype_blocks",
    f"""WITH {O.VECTORS}, n AS ({_nearest_sql('logs', 'known', 'vec_id', 'cluster_id', 3)})
    SELECT q AS log_id, os, i AS cluster_id, distance, CAST(rank AS INTEGER) AS rank FROM n""",
)
def nearest_prototype_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with prototypes too large to broadcast: blocks of twenty."""
    return K.nearest(
        X.vector_logs(spark, sf_dir), _proto_items(spark, sf_dir), 3, "log_id", "cluster_id", broadcast_bytes=0, block_rows=20
    )


@query(
    "line_candidates",
    f"""WITH {O.VECTORS}, {O.PARSED}, n AS ({_nearest_sql('logs', 'known', 'vec_id', 'cluster_id', 1)}),
    s AS (SELECT *, {O.labels("templated || ' ' || line")} AS ev FROM parsed)
    SELECT s.log_id, s.os, s.templated, coalesce(ev[1], 'unknown') AS rule_label, n.distance AS nearest_distance,
      coalesce('kind' || k.label, '') AS nearest_label
    FROM s LEFT JOIN n ON n.q = s.log_id LEFT JOIN known k ON k.cluster_id = n.i
    WHERE len(ev) > 0 OR n.distance IS NULL OR n.distance > {WIDE_THRESHOLD - 0.05}""",
)
def line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose vector is that of their id; lines without a vector are far from everything."""
    near = K.nearest(X.vector_logs(spark, sf_dir), _proto_items(spark, sf_dir), 1, "log_id", "cluster_id")
    labels = _proto_items(spark, sf_dir).select("cluster_id", F.col("label").alias("nearest_label"))
    scored = L.with_signals(LQ.parsed(spark, sf_dir)).join(near.drop("os", "rank").join(labels, "cluster_id"), "log_id", "left")
    found = L.line_candidates(scored, WIDE_THRESHOLD - 0.05)
    return found.drop("raw", "rule_score")


@query(
    "template_neighbors",
    f"""WITH {O.VECTORS}, n AS ({_nearest_sql('logs', 'known', 'vec_id', 'vec_id', 8).replace('q.vec_id, i.vec_id,', 'q.vec_id AS qid, i.vec_id AS iid,').replace('SELECT vec_id AS q, vec_id AS i', 'SELECT qid AS q, iid AS i')})
    SELECT q AS log_id, i AS template_id, n.os, distance, CAST(rank AS INTEGER) AS rank, 'template ' || k.label AS document
    FROM n JOIN known k ON k.vec_id = n.i""",
)
def template_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.template_neighbors(X.vector_logs(spark, sf_dir), X.vector_templates(spark, sf_dir), "log_id")


def _owner_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known vectors as search queries: up to four per (os, label) owner."""
    return X.known_vectors(spark, sf_dir).select(
        F.concat_ws("|", "os", "label").alias("owner_id"), (F.floor(F.col("vec_id") / 30) % 4).cast("int").alias("q_no"), "os",
        "embedding", F.concat(F.lit("k"), F.col("label")).alias("cluster_id"), "vec_id",
    )


RETRIEVE = """
asked AS (SELECT *, os || '|' || label AS owner_id, CAST((vec_id // 30) % 4 AS INTEGER) AS q_no FROM known)"""


@query(
    "retrieve_logs",
    f"""WITH {O.VECTORS}, {RETRIEVE}, r AS (
      SELECT a.owner_id, a.q_no, a.vec_id AS asked_id, a.os, l.vec_id AS log_id, {O.distance('a.v', 'l.v')} AS distance
      FROM asked a JOIN logs l ON a.os = l.os WHERE a.q_no < 3)
    SELECT owner_id, q_no, os, log_id, distance, CAST(rank AS INTEGER) AS rank, 'log ' || log_id AS document FROM (
      SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY distance, log_id) AS rank FROM r) WHERE rank <= 5""",
)
def retrieve_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.retrieve_logs(_owner_queries(spark, sf_dir), X.vector_logs(spark, sf_dir))


@query(
    "retrieve_cluster_logs",
    f"""WITH {O.VECTORS}, r AS (
      SELECT a.vec_id AS owner_id, a.os, l.label, l.vec_id AS log_id, {O.distance('a.v', 'l.v')} AS distance
      FROM known a JOIN logs l ON a.os = l.os AND a.label = l.label)
    SELECT owner_id, os, 'k' || label AS cluster_id, log_id, distance, CAST(rank AS INTEGER) AS rank, 'log ' || log_id AS document FROM (
      SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY distance, log_id) AS rank FROM r) WHERE rank <= 10""",
)
def retrieve_cluster_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _owner_queries(spark, sf_dir).withColumn("owner_id", F.col("vec_id")).withColumn("q_no", F.lit(0))
    return N.retrieve_cluster_logs(asked, X.vector_logs(spark, sf_dir)).drop("q_no")


SEARCH_TEMPLATES_SQL = f"""WITH {O.VECTORS}, o(n, os) AS (VALUES (0, 'linux'), (1, 'macos'), (2, 'windows')),
    r AS (SELECT q.vec_id AS q_id, o.n, i.os, i.vec_id AS id, {O.distance('q.v', 'i.v')} AS distance, 'template ' || i.label AS document
      FROM logs q CROSS JOIN o JOIN known i ON i.os = o.os),
    h AS (SELECT *, row_number() OVER (PARTITION BY q_id, os ORDER BY distance, id) AS rank FROM r),
    d AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY distance, n, q_id, rank) AS dup FROM h WHERE rank <= 5)
    SELECT 'log_template' AS type, os, id, document, distance FROM d WHERE dup = 1
    ORDER BY distance, n, q_id, rank LIMIT 10"""


@query("search_templates", SEARCH_TEMPLATES_SQL)
def search_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = X.vector_logs(spark, sf_dir).select(F.col("log_id").alias("q_id"), "embedding")
    return Q.search_templates(asked, X.vector_templates(spark, sf_dir))


def _by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as members of the cluster of their label."""
    return X.vectors(spark, sf_dir).select("os", F.col("label").alias("cluster"), F.col("vec_id").alias("id"), "embedding")


CENTERS = O.VECTORS + """,
spread AS (SELECT os, label AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM units),
means AS (SELECT os, cluster, pos, avg(x) AS m FROM spread GROUP BY ALL),
sums AS (SELECT os, cluster, list(m ORDER BY pos) AS mean FROM means GROUP BY ALL),
centers AS (SELECT os, cluster, [x / sqrt(list_inner_product(mean, mean)) for x in mean] AS centroid FROM sums)"""


@query(
    "centroids",
    f"""WITH {CENTERS} SELECT os, cluster, CAST(generate_subscripts(centroid, 1) - 1 AS INTEGER) AS pos,
      round(unnest(centroid), 6) AS x FROM centers""",
)
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.centroids(_by_label(spark, sf_dir))
    return found.select("os", "cluster", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(
    "medoids",
    f"""WITH {CENTERS}, d AS (SELECT u.os, u.label AS cluster, u.vec_id, {O.distance('u.v', 'c.centroid')} AS distance
      FROM units u JOIN centers c ON u.os = c.os AND u.label = c.cluster)
    SELECT os, cluster, vec_id AS medoid_id, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY os, cluster ORDER BY distance, vec_id) AS n FROM d) WHERE n = 1""",
)
def medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _by_label(spark, sf_dir)
    return C.medoids(members, C.centroids(members))


@query(
    "cosine_distance",
    f"""WITH {O.VECTORS}, p AS (SELECT *, lead(v) OVER (ORDER BY vec_id) AS w, lead(vec_id) OVER (ORDER BY vec_id) AS other FROM units)
    SELECT vec_id, {O.distance('v', 'w')} AS distance FROM p WHERE other = vec_id + 1""",
)
def cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the one with the next id."""
    v = X.vectors(spark, sf_dir).select("vec_id", V.unit(F.col("embedding")).alias("v"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(after, "vec_id").select("vec_id", F.round(V.cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = LQ.parsed(spark, sf_dir)
    return lines.select("os", (F.col("user_id") % 20).alias("cluster"), F.col("log_id").alias("id"), F.col("templated").alias("document"))


@query(
    "label_clusters",
    f"""WITH {O.PARSED}, s AS (SELECT os, user_id % 20 AS cluster, log_id, {O.labels("templated")} AS ev FROM parsed),
    votes AS (SELECT os, cluster, ev[1] AS label, count(*) AS n, min(log_id) AS first FROM s WHERE len(ev) > 0 GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY os, cluster ORDER BY n DESC, first) AS r FROM votes),
    every AS (SELECT DISTINCT os, cluster FROM s)
    SELECT e.os, e.cluster, coalesce(b.label, 'unknown') AS label, CASE WHEN b.label IS NULL THEN 'no_signal' ELSE 'keyword_rules' END AS rationale
    FROM every e LEFT JOIN best b ON e.os = b.os AND e.cluster = b.cluster AND b.r = 1""",
)
def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.label_clusters(_labelled(spark, sf_dir))


def _prototype_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vectors(spark, sf_dir)
    return v.select(
        "os", F.col("label").cast("string").alias("cluster"), F.col("vec_id").alias("id"),
        F.concat(F.lit("io error on unit "), F.col("vec_id")).alias("document"), "embedding",
    )


@query(
    "build_prototypes",
    f"""WITH {CENTERS}, d AS (SELECT u.os, u.label AS cluster, u.vec_id, {O.distance('u.v', 'c.centroid')} AS distance
      FROM units u JOIN centers c ON u.os = c.os AND u.label = c.cluster),
    m AS (SELECT *, row_number() OVER (PARTITION BY os, cluster ORDER BY distance, vec_id) AS n,
      row_number() OVER (PARTITION BY os, cluster ORDER BY vec_id) AS k FROM d)
    SELECT os, 'cluster_' || cluster AS cluster_id, 'disk' AS label, 'keyword_rules' AS rationale, CAST(count(*) AS INTEGER) AS size,
      max(CASE WHEN n = 1 THEN 'io error on unit ' || vec_id END) AS medoid_document,
      string_agg(CASE WHEN k <= 5 THEN vec_id::VARCHAR END, ',' ORDER BY vec_id) AS exemplars FROM m GROUP BY os, cluster""",
)
def build_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.build_prototypes(_prototype_members(spark, sf_dir))
    exemplars = F.array_join(F.col("exemplar_ids").cast("array<string>"), ",")
    return found.withColumn("exemplars", exemplars).drop("centroid", "exemplar_ids", "solution")


@query(
    "cluster_report",
    f"WITH {O.VECTORS} SELECT os, count(DISTINCT label) AS clusters, count(DISTINCT label) AS prototypes FROM vectors GROUP BY os",
)
def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_report(C.build_prototypes(_prototype_members(spark, sf_dir)))


@query(
    "cluster_input",
    f"""WITH {O.VECTORS} SELECT os, vec_id AS id, 'template ' || label AS document FROM known
    UNION ALL SELECT os, min(vec_id), 'log ' || label FROM logs GROUP BY os, label""",
)
def cluster_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = X.vector_logs(spark, sf_dir).withColumnRenamed("log_id", "id").withColumn("document", F.concat(F.lit("log "), F.substring("cluster_id", 2, 9)))
    return C.cluster_input(X.vector_templates(spark, sf_dir), logs).drop("embedding")


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector six times, five of them with one coordinate moved: clusters of six exist."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(5)))
    at, n = F.col("copy") * 7, F.size("embedding")
    shifted = F.concat(F.slice("embedding", 1, at), F.array(F.get("embedding", at) + 0.05), F.slice("embedding", at + 2, n - at - 1))
    moved = F.when((F.col("copy") > 0) & (at < n), shifted).otherwise(F.col("embedding"))
    rows = X.vectors(spark, sf_dir).withColumn("copy", copies)
    return rows.select(
        "os", F.concat_ws("_", F.lpad(F.col("vec_id").cast("string"), 9, "0"), "copy").alias("id"),
        F.concat(F.lit("unit "), F.col("vec_id"), F.lit(" failed")).alias("document"), moved.alias("embedding"),
    )


@query(
    "single_pass_cluster",
    f"""WITH {O.VECTORS} SELECT os, lpad(vec_id::VARCHAR, 9, '0') || '_' || c AS id, lpad(vec_id::VARCHAR, 9, '0') || '_0' AS cluster
    FROM vectors CROSS JOIN range(6) t(c)""",
)
def single_pass_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random vectors are far apart and their copies near: each cluster is a vector and its copies."""
    return C.single_pass_cluster(near_copies(spark, sf_dir))


@query(
    "cluster_templates",
    f"""WITH {O.VECTORS} SELECT os, 'cluster_' || lpad(vec_id::VARCHAR, 9, '0') || '_0' AS cluster_id, coalesce({O.labels("'unit ' || vec_id || ' failed'")}[1], 'unknown') AS label,
      CAST(6 AS INTEGER) AS size, 'unit ' || vec_id || ' failed' AS medoid_document FROM vectors""",
)
def cluster_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cluster_templates(near_copies(spark, sf_dir)).select("os", "cluster_id", "label", "size", "medoid_document")


def templated_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log table and its distinct texts (os, templated, the first log_id, embedding), each embedded once.

    Both are written once to the shared folder, as the stages behind read them several times; the vectors stay with the texts.
    """
    lines = checkpointed(LQ.parsed(spark, sf_dir).select("log_id", "ts", "os", "templated", "line", "component", "pid", "issue_key"))
    texts = lines.groupBy("os", "templated").agg(F.min("log_id").alias("log_id"))
    return lines, checkpointed(B.embed_text(texts, "templated"))


def text_prototypes(texts: DataFrame) -> DataFrame:
    """Prototypes learned from the distinct templated lines; small groups of lines stay without one."""
    return checkpointed(C.cluster_templates(text_templates(texts).withColumnRenamed("template_id", "id")))


@query(
    "embed_text",
    f"""WITH {O.text_vectors('documents', 'doc_id', 'text', 'tv')}, x AS (SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS x FROM tv)
    SELECT * FROM x WHERE x <> 0""",
)
def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of every document's vector that are not zero."""
    docs = B.embed_text(X.text_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    # the outer form: Spark guards an inner one with a filter that computes the vector twice
    return docs.select("doc_id", F.posexplode_outer("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6)).filter("x <> 0")


@query("assign_clusters", f"WITH RECURSIVE {O.TEXT_CLUSTERS} SELECT os, templated, cluster_id, distance FROM text_clusters")
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, texts = templated_logs(spark, sf_dir)
    assigned, _ = C.assign_clusters(texts, text_prototypes(texts))
    return assigned


@query("logs_with_cluster", f"WITH RECURSIVE {O.TEXT_CLUSTERS} SELECT log_id, os, cluster_id FROM parsed LEFT JOIN text_clusters USING (os, templated)")
def logs_with_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, texts = templated_logs(spark, sf_dir)
    assigned, _ = C.assign_clusters(texts, text_prototypes(texts))
    return C.logs_with_cluster(logs, assigned).select("log_id", "os", "cluster_id")


@query(
    "cluster_with_prototype",
    f"""WITH {O.VECTORS}, c AS (SELECT DISTINCT os, 'c' || lpad((vec_id - vec_id % 20)::VARCHAR, 9, '0') AS cluster_id FROM logs)
    SELECT c.os, c.cluster_id, 'kind' || k.label AS label, coalesce('known ' || k.vec_id, '') AS medoid_document
    FROM c LEFT JOIN known k ON k.cluster_id = c.cluster_id AND k.os = c.os""",
)
def cluster_with_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.concat(F.lit("c"), F.lpad((F.col("log_id") - F.col("log_id") % 20).cast("string"), 9, "0"))
    candidates = X.vector_logs(spark, sf_dir).select("os", ids.alias("cluster_id")).distinct()
    found = N.cluster_with_prototype(candidates, X.prototypes(spark, sf_dir))
    return found.select("os", "cluster_id", "label", "medoid_document")


@query(
    "relabel_prototypes",
    f"""WITH {O.VECTORS}, r AS (SELECT 'c' || lpad((vec_id - vec_id % 20)::VARCHAR, 9, '0') AS cluster_id, os,
      max_by('type' || (vec_id % 4), vec_id) AS ft, max_by(CASE WHEN vec_id % 3 = 0 THEN '' ELSE 'fix ' || vec_id END, vec_id) AS fix
      FROM logs GROUP BY 1, 2)
    SELECT k.os, k.cluster_id, coalesce(r.ft, 'kind' || k.label) AS label,
      CASE WHEN r.ft IS NULL THEN 'keyword_rules' ELSE 'llm_cluster' END AS rationale, nullif(r.fix, '') AS solution
    FROM known k LEFT JOIN r ON r.cluster_id = k.cluster_id AND r.os = k.os""",
)
def relabel_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("log_id")
    results = X.vector_logs(spark, sf_dir).select(
        "os", F.concat(F.lit("c"), F.lpad((n - n % 20).cast("string"), 9, "0")).alias("cluster_id"), n.alias("ts"),
        F.concat(F.lit("type"), n % 4).alias("failure_type"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("fix "), n)).alias("recommendation"),
    )
    return C.relabel_prototypes(X.prototypes(spark, sf_dir), results).select("os", "cluster_id", "label", "rationale", "solution")


@query(
    "feedback_logs",
    f"""WITH {O.ALERTS}, {O.PARSED}, named AS (
      SELECT a.id AS alert_id, a.os, unnest([a.o_custkey, a.o_custkey + 4]) AS log_id FROM alerts a JOIN feedback f ON f.id = a.id AND f.feedback = 'correct')
    SELECT n.alert_id, n.os, n.log_id, p.templated FROM named n JOIN parsed p ON p.log_id = n.log_id AND p.os = n.os""",
)
def feedback_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = LQ.parsed(spark, sf_dir).select("os", "log_id", "templated")
    return A.feedback_logs(X.alerts(spark, sf_dir), X.feedback_events(spark, sf_dir), logs).select("alert_id", "os", "log_id", "templated")


@query("improve_prototypes")
def improve_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototypes learned from the logs of alerts marked correct, added to the known ones."""
    lines, texts = templated_logs(spark, sf_dir)
    good = A.feedback_logs(X.alerts(spark, sf_dir), X.feedback_events(spark, sf_dir), lines)
    good = good.join(texts.select("os", "templated", "embedding"), ["os", "templated"])
    learned = good.select("os", F.col("log_id").alias("id"), F.col("templated").alias("document"), "embedding")
    improved = C.improve_prototypes(text_prototypes(texts), learned.dropDuplicates(["os", "id"]), "run1")
    return improved.select("os", "cluster_id", "label", "size", "medoid_document")


@query(
    "issue_context",
    f"""WITH {O.ISSUES.replace('120000000', '86400000000')}, lines AS (
      SELECT os, issue_key, session_us, string_agg('- ' || templated, chr(10) ORDER BY rn) FILTER (WHERE rn <= 50) AS recent,
        string_agg('- ' || templated, chr(10) ORDER BY rn) FILTER (WHERE rn <= 8) AS examples,
        string_agg('- ' || templated, chr(10) ORDER BY rn) FILTER (WHERE rn <= 20) AS extra
      FROM ranked GROUP BY ALL) SELECT * FROM lines""",
)
def issue_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.build_issues(LQ.parsed(spark, sf_dir), gap_sec=86_400)
    texts = F.col("logs")["templated"]
    return N.issue_context(found, texts, texts, texts).select("os", "issue_key", "session_us", "recent", "examples", "extra")


NEAR_TEXTS = f"""n AS ({_nearest_sql('logs', 'known', 'vec_id', 'vec_id', 8).replace('q.vec_id, i.vec_id,', 'q.vec_id AS qid, i.vec_id AS iid,').replace('SELECT vec_id AS q, vec_id AS i', 'SELECT qid AS q, iid AS i')}),
shown AS (SELECT n.q, n.rank, '- template ' || k.label AS line FROM n JOIN known k ON k.vec_id = n.i)"""


def _near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight template texts nearest to each log, in the order of their distance."""
    near = N.template_neighbors(X.vector_logs(spark, sf_dir), X.vector_templates(spark, sf_dir), "log_id")
    return near.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document")))["document"].alias("near"))


@query(
    "line_context",
    f"""WITH {O.VECTORS}, {NEAR_TEXTS} SELECT l.vec_id AS log_id, l.os, coalesce(string_agg(s.line, chr(10) ORDER BY s.rank) FILTER (WHERE s.rank <= 5), '') AS examples
    FROM logs l LEFT JOIN shown s ON s.q = l.vec_id GROUP BY 1, 2""",
)
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier of single lines is shown: the five nearest templates."""
    rows = X.vector_logs(spark, sf_dir).select("log_id", "os").join(_near_texts(spark, sf_dir), "log_id", "left")
    return N.line_context(rows, F.col("near")).drop("near")


@query(
    "cluster_context",
    f"""WITH {O.VECTORS}, {NEAR_TEXTS}, r AS (SELECT a.vec_id AS owner, l.vec_id AS log_id, {O.distance('a.v', 'l.v')} AS distance FROM logs a JOIN logs l ON a.os = l.os AND a.label = l.label),
    k AS (SELECT owner, log_id, row_number() OVER (PARTITION BY owner ORDER BY distance, log_id) AS rank FROM r),
    t AS (SELECT owner, string_agg('- log ' || log_id, chr(10) ORDER BY rank) AS recent FROM k WHERE rank <= 10 GROUP BY 1),
    e AS (SELECT q, string_agg(line, chr(10) ORDER BY rank) AS examples FROM shown GROUP BY 1)
    SELECT l.vec_id AS log_id, l.os, 'k' || l.label AS cluster_id, coalesce(t.recent, '') AS recent, coalesce(e.examples, '') AS examples
    FROM logs l LEFT JOIN t ON t.owner = l.vec_id LEFT JOIN e ON e.q = l.vec_id""",
)
def cluster_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier of clusters is shown: ten logs of the cluster near its medoid (here every log stands for one), eight templates."""
    logs = X.vector_logs(spark, sf_dir)
    asked = logs.select(F.col("log_id").alias("owner_id"), "os", "cluster_id", F.lit(0).alias("q_no"), "embedding")
    found = N.retrieve_cluster_logs(asked, logs).groupBy(F.col("owner_id").alias("log_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "document")))["document"].alias("found"))
    rows = logs.select("log_id", "os", "cluster_id").join(_near_texts(spark, sf_dir), "log_id", "left").join(found, "log_id", "left")
    return N.cluster_context(rows, F.col("near"), F.col("found")).drop("near", "found")


@query(
    "enrich_issues",
    f"""WITH {O.ISSUES}, l AS (SELECT os, issue_key, session_us, rn, {O.labels("templated || ' ' || line")} AS ev FROM ranked WHERE rn <= 50),
    v AS (SELECT os, issue_key, session_us, ev[1] AS label, count(*) AS n, min(rn) AS first FROM l WHERE len(ev) > 0 GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY os, issue_key, session_us ORDER BY n DESC, first) AS r FROM v),
    s AS (SELECT os, issue_key, session_us, count(*) AS n_logs FROM l GROUP BY ALL)
    SELECT s.os || '|' || s.issue_key || '|' || s.session_us AS id, coalesce(b.label, 'unknown') AS failure_type,
      coalesce(round(b.n / s.n_logs, 4), 0.0) AS confidence, CAST(s.n_logs AS INTEGER) AS n_logs
    FROM s LEFT JOIN b ON b.os = s.os AND b.issue_key = s.issue_key AND b.session_us = s.session_us AND b.r = 1""",
)
def enrich_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues to alerts: neighbours, retrieval, classification."""
    lines, texts = templated_logs(spark, sf_dir)
    found = checkpointed(I.build_issues(lines).withColumn("id", F.concat_ws("|", "os", "issue_key", "session_us")))
    logs = lines.select("os", "log_id", F.col("templated").alias("document"))
    templates = text_templates(texts)
    done = N.enrich_issues(found, templates, logs, texts=templates)
    result = F.from_json("result", N.RESULT_TYPE)
    return done.select("id", result["failure_type"].alias("failure_type"), result["confidence"].alias("confidence"), F.size("log_ids").alias("n_logs"))


def text_templates(texts: DataFrame) -> DataFrame:
    """Distinct masked lines as the template catalogue of their OS."""
    return texts.select("os", F.col("templated").alias("document"), F.col("log_id").alias("template_id"), "embedding")


@query("enrich_clusters", f"WITH RECURSIVE {O.CLUSTER_RESULTS} SELECT os, cluster_id, medoid_document, failure_type FROM cluster_results")
def enrich_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that reached twenty logs to alerts."""
    logs, texts = templated_logs(spark, sf_dir)
    protos = text_prototypes(texts)
    assigned, created = C.assign_clusters(texts, protos)
    placed = checkpointed(C.logs_with_cluster(logs.select("log_id", "ts", "os", "templated"), assigned))
    candidates = I.cluster_candidates(placed)
    items = placed.select("os", "cluster_id", "log_id", F.col("templated").alias("document"))
    templates = text_templates(texts)
    done, _ = N.enrich_clusters(checkpointed(candidates), protos.unionByName(created), templates, items, texts=templates)
    result = F.from_json("result", N.RESULT_TYPE)
    return done.select("os", "cluster_id", "medoid_document", result["failure_type"].alias("failure_type"))
