"""Reading classification results and query lists that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logweave.functions.points import get, is_object, truthy
from logweave.functions.text import let


def parse_result(raw: Column) -> Column:
    """JSON text as VARIANT: as it is, else with ``'`` as ``"``, else wrapped as ``{raw}``."""
    raw = F.coalesce(raw, F.lit(""))
    return F.when(raw == "", F.parse_json(F.lit("{}"))).otherwise(
        F.coalesce(
            F.try_parse_json(raw),
            F.try_parse_json(F.replace(raw, F.lit("'"), F.lit('"'))),
            F.parse_json(F.to_json(F.struct(raw.alias("raw")))),
        )
    )


def strict_result(raw: Column) -> Column:
    """A JSON object as VARIANT, an empty one where there is no text; null for anything else."""
    parsed = F.try_parse_json(raw)
    return F.when(raw.isNull(), F.parse_json(F.lit("{}"))).otherwise(F.when(is_object(parsed), parsed))


def filled(own: Column, result: Column, key: str) -> Column:
    """A row's own text, else that of its result."""
    return F.coalesce(F.nullif(own, F.lit("")), result_text(result, key))


def result_text(result: Column, key: str) -> Column:
    return F.coalesce(get(result, f"$.{key}", "string"), F.lit(""))


def parse_query_list(answer: Column, n: int = 3) -> Column:
    """Up to ``n`` queries of ``{"queries": [...]}`` or of a bare list, else none."""

    def found(value: Column) -> Column:
        return F.coalesce(
            F.when(is_object(value), get(value, "$.queries", "array<string>")),
            get(value, "$", "array<string>"),
            F.array().cast("array<string>"),
        )

    return F.slice(let(F.try_parse_json(answer), found), 1, n)


def alert_fields(result: Column) -> Column:
    """The alert columns taken from a classification result (VARIANT)."""

    def fields(r: Column) -> Column:
        return F.struct(
            F.coalesce(truthy(get(r, "$.is_hardware_failure")), F.lit(False)).alias("is_hardware_failure"),
            result_text(r, "failure_type").alias("failure_type"),
            result_text(r, "confidence").alias("confidence"),
        )

    return let(result, fields)
