"""Keyed insert-or-replace, fetch by id, and the first rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert_latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest version per key.

    Each map task keeps one row per key before the shuffle, so many versions of one key cost little.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def fetch_by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_semi")


def first_n(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, whatever the size of the group.

    Spark itself drops rows before the shuffle only for small ``n``. So each group is first cut
    into hash lanes that keep their own first ``n``, and only those meet in one window.
    """
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lane = F.pmod(F.xxhash64(*order), F.lit(lanes))
    for more in (["_lane"], []):
        w = Window.partitionBy(*keys, *more).orderBy(*order)
        rows = rows.withColumn("_lane", lane).withColumn("_n", F.row_number().over(w))
        rows = rows.filter(F.col("_n") <= n).drop("_n", "_lane")
    return rows


def explode_once(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """Add ``name``, one row per array element; the array is computed once.

    The outer form is used because Spark guards an inner one with a filter on the array, which
    would compute it twice.
    """
    return rows.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())
