"""Bitmaps of hashes: a small table that tells which keys are certainly not in a larger one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logweave.session import checkpointed

#: Bits of one bucket (a bitmap of Spark's size), bits each key gets on average, bits a key sets.
BUCKET, BITS_PER_KEY, PROBES = 32_768, 16, 4
#: Buckets at most: 32 MB, the bound of what is broadcast. With more keys the bitmap fills up and lets more
#: keys pass that are not there; whoever uses it joins on the keys behind it.
MAX_BUCKETS = 8_192


def probes(key: Column) -> list[Column]:
    """Places of a key in its bucket; they may coincide, which only lets more keys pass."""
    spread = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.shiftrightunsigned(spread, 15 * i), F.lit(BUCKET)).cast("int") for i in range(PROBES)]


def is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), place.bitwiseAND(7) + 1)) != 0


def hash_bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, bits) over the longs of column ``key``, and the number of buckets."""
    buckets = min(MAX_BUCKETS, max(1, -(-keys.count() * BITS_PER_KEY // BUCKET)))
    placed = keys.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), F.explode(F.array(*probes(F.col("key")))).alias("place"))
    return checkpointed(placed.distinct().groupBy("bucket").agg(F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))), buckets


def _marked(rows: DataFrame, key: Column, bitmap: tuple[DataFrame, int]) -> DataFrame:
    table, buckets = bitmap
    met = rows.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int")).join(
        F.broadcast(table.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))), "_bucket", "left"
    )
    hit = F.lit(True)
    for place in probes(F.col("_key")):
        hit = hit & is_set(F.col("_bits"), place)
    return met.withColumn("_hit", F.col("_bits").isNotNull() & hit)


def drop_absent(rows: DataFrame, key: Column, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """Rows whose ``key`` (a long, not null) may be among the keys of the bitmap."""
    return _marked(rows, key, bitmap).filter("_hit").drop("_key", "_bucket", "_bits", "_hit")


def drop_present(rows: DataFrame, key: Column, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """The rows that ``drop_absent`` leaves out."""
    return _marked(rows, key, bitmap).filter("not _hit").drop("_key", "_bucket", "_bits", "_hit")
