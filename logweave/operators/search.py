"""Searching alerts, issues and templates.

Search texts are a handful of parameters, so they become literals in one expression per row
instead of a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions import results as J, rules as R, text as T
from logweave.operators.alerts import newest
from logweave.operators.knn import nearest

LIMIT = 10


def relevance(text: Column, queries: Sequence[str]) -> Column:
    """1 per query contained whole, 0.5 per word of more than three letters contained."""
    score = F.lit(0.0)
    for query in queries:
        low = query.lower()
        score = score + F.when(text.contains(low), 1.0).otherwise(0.0)
        for word in low.split():
            if len(word) > 3:
                score = score + F.when(text.contains(word), 0.5).otherwise(0.0)
    return score


def _best(rows: DataFrame, text: Column, queries: Sequence[str], limit: int) -> DataFrame:
    scored = rows.withColumn("relevance", relevance(F.lower(text), queries)).filter(F.col("relevance") > 0)
    return scored.orderBy(F.col("relevance").desc(), F.col("ms").desc(), F.col("seq").desc()).limit(limit)


def _window(rows: DataFrame, scan: int | None) -> DataFrame:
    return rows if scan is None else newest(rows, scan)


def search_alerts(stream: DataFrame, queries: Sequence[str], limit: int = LIMIT, scan: int | None = None) -> DataFrame:
    """Most relevant alerts of the stream, or of its newest ``scan`` rows.

    An alert whose result is no JSON object is passed over; one without a result is not.
    """
    # an element of an outer explode: the filter on a plain column would be pushed below the dealing of the rows, and every
    # result be read once more there, in the few tasks of the scan
    read = F.explode_outer(F.array(J.strict_result(F.col("result"))))
    rows = _window(stream, scan).withColumn("_r", read).filter("_r IS NOT NULL")
    rows = rows.withColumns({
        "summary": J.filled(F.col("summary"), F.col("_r"), "summary"),
        "solution": J.filled(F.col("solution"), F.col("_r"), "recommendation"),
        "failure_type": J.result_text(F.col("_r"), "failure_type"),
    }).drop("_r")
    text = F.concat_ws(" ", *[T.or_empty(F.col(c)) for c in ("summary", "solution", "failure_type", "os")])
    return _best(rows, text, queries, limit)


def search_incidents(
    entries: DataFrame, queries: Sequence[str], limit: int = LIMIT, scan: int | None = None
) -> DataFrame:
    """Most relevant issues, or those of the newest ``scan``; the summary is cut to 500 letters in the result."""
    text = F.concat_ws(" ", *[T.or_empty(F.col(c)) for c in ("templated_summary", "os", "issue_key")])
    ordered = entries if "seq" in entries.columns else entries.withColumn("seq", F.col("id"))
    found = _best(_window(ordered, scan), text, queries, limit)
    return found.withColumn("templated_summary", F.substring("templated_summary", 1, 500))


def search_alerts_structured(
    listed: DataFrame,
    severity: str = "",
    os: str = "",
    failure_type_contains: str = "",
    ascending: bool = False,
    limit: int = 5,
    scan: int | None = None,
) -> DataFrame:
    """Filter listed alerts (``alerts.list_alerts``), or the newest ``scan`` of them, by severity, OS and
    failure type."""
    rows = _window(listed, scan).withColumn("severity", R.derive_severity(F.col("failure_type")))
    if severity.strip():
        rows = rows.filter(F.col("severity") == severity.strip().lower())
    if os.strip():
        rows = rows.filter(F.lower("os") == os.strip().lower())
    if failure_type_contains.strip():
        rows = rows.filter(F.lower("failure_type").contains(failure_type_contains.strip().lower()))
    return newest(rows, limit, ascending)


def search_templates(
    queries: DataFrame,
    templates: DataFrame,
    os_list: Sequence[str] = ("linux", "macos", "windows"),
    limit: int = LIMIT,
) -> DataFrame:
    """Templates nearest to any query, over several OSes.

    ``queries`` has q_id and embedding; ``templates`` has os, id, document and embedding. Per OS
    and query at most five are taken; a text found more than once keeps its nearest hit.
    """
    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(o).alias("os")) for n, o in enumerate(os_list)])
    asked = queries.withColumn("_o", F.explode(places)).select("q_id", "embedding", "_o.os", "_o.n")
    hits = nearest(asked, templates, min(limit, 5), "q_id", "id")
    order = asked.select("q_id", "os", "n").distinct()
    found = hits.join(order, ["q_id", "os"]).join(templates.select("os", "id", "document"), ["os", "id"])
    found = found.withColumn("document", F.substring("document", 1, 500))
    place = F.struct("distance", "n", "q_id", "rank", "id", "os")
    best = found.groupBy("document").agg(F.min(place).alias("_p"))
    first = best.orderBy("_p").limit(limit)
    return first.select(
        F.lit("log_template").alias("type"), "_p.os", "_p.id", "document", "_p.distance"
    )


def search_sources(alerts: DataFrame, incidents: DataFrame, templates: DataFrame, top: int = 5) -> DataFrame:
    """The first hits of the three searches as one list, tagged by type."""
    by_relevance = [F.col(c).desc() for c in ("relevance", "ms", "seq")]
    a = alerts.orderBy(*by_relevance).limit(top).select(
        F.lit("alert").alias("type"), "id", "os", "summary", "relevance"
    )
    i = incidents.orderBy(*by_relevance).limit(top).select(
        F.lit("incident").alias("type"), "id", "os", F.substring("templated_summary", 1, 200).alias("summary"), "relevance"
    )
    t = templates.orderBy("distance", "document").limit(top).select(
        F.lit("log").alias("type"), "os", F.substring("document", 1, 200).alias("document"), "distance"
    )
    return a.unionByName(i).unionByName(t, allowMissingColumns=True)
