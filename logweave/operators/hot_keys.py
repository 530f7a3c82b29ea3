"""Joins of rows with a table of unique keys when some keys stand on very many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Rows from which a key counts as hot, and the most hot keys there can be: the threshold grows with the rows.
LEAST, MOST_KEYS = 1_000, 10_000


def hot_keys(rows: DataFrame, keys: Sequence[str], least: int = LEAST) -> DataFrame | None:
    """(keys, _copies): keys on more than max(``least``, rows / MOST_KEYS) rows with the number of parts of
    that size that they make, at most MOST_KEYS rows; None if the table is too small for any. ``rows`` is a written table."""
    n = rows.count()
    if n <= least:
        return None
    part = max(least, n // MOST_KEYS)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > part)
    return counts.select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_copies"))


def look_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], by: Column, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key; ``how`` is inner or left.

    The rows of a hot key are dealt by the hash of ``by`` to as many parts as its ``_copies`` say, and its
    row of the table is copied to each, so no task holds them all. Copies are at most rows / threshold in all.
    """
    if hot is None:
        return rows.join(table, list(keys), how)
    copies = F.coalesce(F.col("_copies"), F.lit(1))
    known = F.broadcast(hot)
    dealt = rows.join(known, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(by), copies).cast("int")).drop("_copies")
    copied = table.join(known, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
