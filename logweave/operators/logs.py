"""Log lines to parsed, masked and scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from logweave.functions import rules as R, text as T

PROTOTYPE_THRESHOLD = 0.25


def parse_and_template(lines: DataFrame, parse_windows: bool = False) -> DataFrame:
    """Add os, component, pid, content, templated and issue_key to rows with source and line.

    Lines that do not parse keep their whole text as content of component ``unknown``.
    Servicing lines are parsed only on request.
    """
    line = T.or_empty(F.col("line"))
    df = lines.withColumns({"os": T.os_from_source(F.col("source")), "line": line})
    groups = F.when(F.col("os").isin("linux", "macos"), T.match_groups(F.col("line"), T.SYSLOG_PATTERN, (5, 6, 7)))
    if parse_windows:
        servicing = T.match_groups(F.col("line"), T.SERVICING_PATTERN, (4, 5))
        groups = groups.when(F.col("os") == "windows", servicing)
    df = df.withColumn("_g", groups)
    found = F.size("_g") > 1
    has_pid = F.size("_g") == 3
    df = df.withColumns(
        {
            "component": F.when(found, T.strip(F.get("_g", F.lit(0)))).otherwise("unknown"),
            "pid": F.when(has_pid, F.get("_g", F.lit(1))).otherwise(""),
            "content": F.when(found, F.element_at("_g", -1)).otherwise(F.col("line")),
        }
    ).drop("_g")
    df = df.withColumn("_masked", T.template_content(F.col("content")))
    templated = T.render_templated(F.col("component"), F.col("pid"), F.col("_masked"))
    key = T.issue_key(F.col("os"), F.col("component"), F.col("pid"))
    # never null, and said so: a join on them then brings no null filter, which Spark would push
    # below the parsing and so evaluate the patterns twice
    return df.withColumns({"templated": T.or_empty(templated), "issue_key": T.or_empty(key)}).drop("_masked")


def with_signals(logs: DataFrame, rules: Sequence[tuple[str, str]] = R.FAILURE_RULES) -> DataFrame:
    """Add has_signal, label, score and evidence, scored over masked and raw text together."""
    text = F.concat_ws(" ", F.col("templated"), F.col("line"))
    df = logs.withColumn("_labels", R.failure_labels(text, rules))
    signal = R.signal_from_labels(F.col("_labels"))
    return df.withColumn("_signal", signal).select(*logs.columns, "_signal.*")


def line_candidates(scored: DataFrame, threshold: float = PROTOTYPE_THRESHOLD) -> DataFrame:
    """Lines with a failure signal or far from every prototype.

    ``scored`` has the signal columns and distance and nearest_label of the nearest prototype; a
    line without a distance is far.
    """
    far = F.col("distance").isNull() | (F.col("distance") > threshold)
    return scored.filter(F.col("has_signal") | far).select(
        "log_id",
        "os",
        F.col("line").alias("raw"),
        "templated",
        F.col("label").alias("rule_label"),
        F.col("score").alias("rule_score"),
        F.col("distance").alias("nearest_distance"),
        T.or_empty(F.col("nearest_label")).alias("nearest_label"),
    )
