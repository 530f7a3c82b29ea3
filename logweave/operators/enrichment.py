"""Context, classification and alerts for issues and clusters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.functions import rules as R, text as T
from logweave.operators.clustering import relabel_prototypes
from logweave.operators.embedding import Embedder, embed_distinct
from logweave.operators.hot_keys import hot_keys, look_up
from logweave.operators.knn import nearest
from logweave.session import checkpointed

NEIGHBORS = 8
MAX_QUERIES = 3
LOGS_PER_QUERY = 5
CLUSTER_LOGS_PER_QUERY = 10

Classifier = Callable[[Mapping[str, object]], Mapping[str, object]]
RESULT_TYPE = (
    "struct<is_hardware_failure:boolean,failure_type:string,confidence:double,"
    "top_signals:array<string>,summary:string,recommendation:string>"
)


def vector_key(vector: Column) -> Column:
    """A text of 128 bits of hash that stands for a vector."""
    return F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(F.lit("again"), vector)))


def first_per_text(logs: DataFrame, k: int, by: str = "os") -> DataFrame:
    """At most ``k`` logs per (by, document): equal texts are equally near, so no more can be among k."""
    w = Window.partitionBy(by, "document").orderBy("log_id")
    return logs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def vector_hits(vectors: DataFrame, items: DataFrame, k: int, item_id: str, by: str = "os") -> DataFrame:
    """The ``k`` items nearest to each distinct vector (by, _v, embedding): by, _v, item_id, distance, rank, document.

    Of items with equal vectors only the ``k`` lowest ids take part, as they are equally near.
    """
    keyed = items.select(by, item_id, "document", "embedding").withColumn("_v", vector_key(F.col("embedding")))
    w = Window.partitionBy(by, "_v").orderBy(item_id)
    first = checkpointed(keyed.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n", "_v"))
    hits = nearest(vectors, first, k, "_v", item_id, by=by)
    return hits.join(first.select(by, item_id, "document"), [by, item_id])


def _distinct_vectors(asked: DataFrame, by: str = "os") -> DataFrame:
    return asked.select(by, "_v", "embedding").dropDuplicates([by, "_v"])


def template_neighbors(queries: DataFrame, templates: DataFrame, query_id: str, k: int = NEIGHBORS) -> DataFrame:
    """The ``k`` templates nearest to each query vector (issue summary or cluster centroid); equal vectors are looked up once."""
    asked = queries.select("os", query_id, "embedding").withColumn("_v", vector_key(F.col("embedding")))
    hits = vector_hits(_distinct_vectors(asked), templates, k, "template_id")
    return asked.select("os", query_id, "_v").join(hits, ["os", "_v"]).drop("_v")


def with_vectors(logs: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Logs with the vectors of ``texts`` (os, document, embedding), where they do not have their own."""
    return logs if texts is None else logs.join(texts.select("os", "document", "embedding"), ["os", "document"])


def retrieve_logs(
    queries: DataFrame, logs: DataFrame, k: int = LOGS_PER_QUERY, max_queries: int = MAX_QUERIES, texts: DataFrame | None = None
) -> DataFrame:
    """Per query the ``k`` nearest logs, first queries of each owner only, hits not deduplicated.

    ``queries`` has owner_id, q_no (from 0), os and embedding; ``logs`` os, log_id, document and
    embedding, or no vector where ``texts`` (os, document, embedding) has one for each text. Equal query vectors of an OS are looked up once.
    """
    asked = queries.filter(F.col("q_no") < max_queries).withColumn("_v", vector_key(F.col("embedding")))
    hits = vector_hits(_distinct_vectors(asked), with_vectors(first_per_text(logs, k), texts), k, "log_id")
    return asked.select("owner_id", "q_no", "os", "_v").join(hits, ["os", "_v"]).drop("_v")


def retrieve_cluster_logs(queries: DataFrame, logs: DataFrame, k: int = CLUSTER_LOGS_PER_QUERY, texts: DataFrame | None = None) -> DataFrame:
    """As :func:`retrieve_logs` with queries and logs of the same cluster (column cluster_id)."""
    scope = F.to_json(F.struct("os", "cluster_id"))
    asked = queries.withColumns({"scope": scope, "_v": vector_key(F.col("embedding"))})
    items = with_vectors(first_per_text(logs.withColumn("scope", scope), k, "scope"), texts)
    hits = vector_hits(_distinct_vectors(asked, "scope"), items, k, "log_id", "scope")
    return asked.select("scope", "_v", "os", "cluster_id", "owner_id", "q_no").join(hits, ["scope", "_v"]).drop("scope", "_v")


def cluster_with_prototype(candidates: DataFrame, prototypes: DataFrame) -> DataFrame:
    """Cluster candidates with their prototype; unknown clusters keep empty values."""
    return candidates.join(prototypes, ["os", "cluster_id"], "left").withColumn(
        "medoid_document", T.or_empty(F.col("medoid_document"))
    )


def bullets(texts: Column, limit: int) -> Column:
    lines = F.transform(F.slice(texts, 1, limit), lambda t: F.concat(F.lit("- "), T.or_empty(t)))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def issue_context(rows: DataFrame, logs: Column, neighbors: Column, retrieved: Column) -> DataFrame:
    """Add the bulleted texts a classifier sees: first 50 logs, 8 neighbours, 20 retrieved."""
    return rows.withColumns(
        {
            "recent": bullets(logs, 50),
            "examples": bullets(neighbors, 8),
            "extra": bullets(retrieved, 20),
        }
    )


def cluster_context(rows: DataFrame, neighbors: Column, retrieved: Column) -> DataFrame:
    """Add what a cluster classifier sees: first 50 retrieved logs and 8 neighbours."""
    return rows.withColumns({"recent": bullets(retrieved, 50), "examples": bullets(neighbors, 8)})


#: Columns that a classifier is shown, where a row has them: an issue, a cluster with its medoid, or a line.
CONTEXT = ("os", "cluster_id", "medoid_document", "line", "templated", "recent", "examples", "extra")


def line_context(rows: DataFrame, neighbors: Column) -> DataFrame:
    """Add the five neighbours shown for a single line (line, templated)."""
    return rows.withColumn("examples", bullets(neighbors, 5))


def keyword_result(texts: Column) -> Column:
    """Default classification: the majority failure label of the texts, with its share."""
    first = F.array_compact(F.transform(texts, lambda t: F.get(R.failure_labels(t), F.lit(0))))

    def voted(labels: Column, kinds: Column) -> Column:
        votes = F.transform(
            kinds,
            lambda k, i: F.struct(
                (-F.size(F.filter(labels, lambda x: x == k))).alias("n"), i.alias("at"), k.alias("label")
            ),
        )
        return T.let(F.array_min(votes), lambda best: result(best, kinds))

    def result(best: Column, kinds: Column) -> Column:
        return F.struct(
            best.isNotNull().alias("is_hardware_failure"),
            F.coalesce(best["label"], F.lit("unknown")).alias("failure_type"),
            F.coalesce(F.round(-best["n"] / F.size(texts), 4), F.lit(0.0)).alias("confidence"),
            kinds.alias("top_signals"),
            F.coalesce(F.get(texts, F.lit(0)), F.lit("")).alias("summary"),
            F.lit("").alias("recommendation"),
        ).cast(RESULT_TYPE)

    # the patterns run once for each text, however often the labels are used
    return T.let(first, lambda labels: T.let(F.array_distinct(labels), lambda kinds: voted(labels, kinds)))


def classify(rows: DataFrame, texts: Column, classifier: Classifier | None = None) -> DataFrame:
    """Add ``result`` as JSON text; a user classifier gets the row's context columns as a dict."""
    if classifier is None:
        return rows.withColumn("_texts", texts).withColumn("result", F.to_json(keyword_result(F.col("_texts")))).drop("_texts")
    names = [c for c in CONTEXT if c in rows.columns]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([json.dumps(classifier(r)) for r in batch.to_dict("records")])

    return rows.withColumn("result", run(F.struct(*names)))


def _texts_of(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    picked = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "document"))).alias("_h"))
    return picked.select(*keys, F.col("_h")["document"].alias("texts"))


def _list_up(asked: DataFrame, hits: DataFrame, by: Column) -> DataFrame:
    """``asked`` (a written table with os and _v) with the texts found for its vector, gathered once for each distinct one."""
    keys = ["os", "_v"]
    return look_up(asked, _texts_of(hits, keys, ["rank"]), keys, by, hot_keys(asked, keys)).drop(*keys)


def enrich_issues(
    issues: DataFrame,
    templates: DataFrame,
    logs: DataFrame,
    classifier: Classifier | None = None,
    embedder: Embedder | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Issues (id, os, issue_key, templated_summary, logs) to alerts with context and result.

    Queries are the first distinct templated lines of the issue. Every bounded list (8 neighbours,
    3 x 5 logs) is built per distinct vector from ranked hits, never from all pairs. ``issues`` is read
    several times: a written table. ``texts`` as in :func:`retrieve_logs`.
    """
    summaries = issues.select("id", "os", F.col("templated_summary").alias("text"))
    asked = issues.select(
        F.col("id").alias("owner_id"), "os",
        F.posexplode(F.slice(F.array_distinct(F.col("logs")["templated"]), 1, MAX_QUERIES)).alias("q_no", "text"),
    )
    both = summaries.select("os", "text").unionByName(asked.select("os", "text"))
    vectors = checkpointed(embed_distinct(both, ["os"], "text", embedder).withColumn("_v", vector_key(F.col("embedding"))))
    distinct = checkpointed(_distinct_vectors(vectors))
    names = vectors.select("os", "text", "_v")
    summaries = checkpointed(summaries.join(names, ["os", "text"]).select("id", "os", "_v"))
    asked = checkpointed(asked.join(names, ["os", "text"]).select("owner_id", "q_no", "os", "_v"))
    of = lambda rows: distinct.join(rows.select("os", "_v").distinct(), ["os", "_v"], "left_semi")
    near = vector_hits(of(summaries), templates, NEIGHBORS, "template_id")
    items = with_vectors(first_per_text(logs, LOGS_PER_QUERY), texts)
    found = vector_hits(of(asked), items, LOGS_PER_QUERY, "log_id")
    neighbors = _list_up(summaries, near, F.col("id")).select("id", F.col("texts").alias("_near"))
    lists = _list_up(asked, found, F.col("owner_id")).groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("q_no", "texts"))).alias("_l"))
    retrieved = lists.select("id", F.flatten(F.col("_l")["texts"]).alias("_found"))
    rows = issues.join(neighbors, "id", "left").join(retrieved, "id", "left")
    rows = issue_context(rows, F.col("logs")["templated"], F.col("_near"), F.col("_found"))
    lines = F.transform("logs", lambda x: F.concat_ws(" ", x["templated"], x["raw"]))
    done = classify(rows, lines, classifier)
    return done.withColumn("log_ids", F.col("logs")["log_id"]).drop("_near", "_found")


def enrich_clusters(
    candidates: DataFrame,
    prototypes: DataFrame,
    templates: DataFrame,
    logs: DataFrame,
    classifier: Classifier | None = None,
    embedder: Embedder | None = None,
    texts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cluster candidates (os, cluster_id, ts) to alert rows, and the relabelled prototypes."""
    rows = cluster_with_prototype(candidates, prototypes).withColumn("id", F.concat_ws("|", "os", "cluster_id"))
    near = template_neighbors(rows.select("id", "os", F.col("centroid").alias("embedding")), templates, "id")
    medoids = embed_distinct(rows.select("os", F.col("medoid_document").alias("text")), ["os"], "text", embedder)
    asked = rows.select(F.col("id").alias("owner_id"), "os", "cluster_id", F.lit(0).alias("q_no"), F.col("medoid_document").alias("text"))
    found = retrieve_cluster_logs(asked.join(medoids, ["os", "text"]), logs, texts=texts)
    neighbors = _texts_of(near, ["id"], ["rank"]).withColumnRenamed("texts", "_near")
    retrieved = _texts_of(found, ["owner_id"], ["q_no", "rank"]).select(F.col("owner_id").alias("id"), F.col("texts").alias("_found"))
    rows = rows.join(neighbors, "id", "left").join(retrieved, "id", "left")
    rows = cluster_context(rows, F.col("_near"), F.col("_found"))
    seen = F.concat(F.array("medoid_document"), F.coalesce("_found", F.array().cast("array<string>")))
    done = classify(rows, seen, classifier).drop("_near", "_found")
    result = F.from_json("result", RESULT_TYPE)
    learned = done.select("os", "cluster_id", "ts", result["failure_type"].alias("failure_type"), result["recommendation"].alias("recommendation"))
    return done, relabel_prototypes(prototypes, learned)
