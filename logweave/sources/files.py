"""Text logs and template catalogues from files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logweave.functions import text as T
from logweave.operators.upsert import upsert_latest

# Catalogue file per OS.
TEMPLATE_FILES = {
    "macos": "Mac_2k.log_templates.csv",
    "linux": "Linux_2k.log_templates.csv",
    "windows": "Windows_2k.log_templates.csv",
}
TEMPLATE_SCHEMA = "EventId string, EventTemplate string"


def _file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def _lines(raw: DataFrame) -> DataFrame:
    """Broken UTF-8 becomes the replacement character; whitespace around the line goes."""
    return raw.select(
        _file_name(F.col("_metadata.file_path")).alias("source"),
        T.strip(F.make_valid_utf8("value")).alias("line"),
    )


def scan_text_logs(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per line of the files at ``path``: (source = file name, line)."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return _lines(reader.format("text").load(path))


def stream_text_logs(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream: every new file is read once. ``tail.follow_text_logs`` follows growing files."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _lines(reader.format("text").load(path))


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates of one catalogue: (event_id, template); blank templates are dropped.

    A missing id becomes ``auto_<n>``, n being the templates kept before it in the file. The
    running number is the row's number within its file block plus the rows of earlier blocks, so
    a large catalogue is numbered without passing through one task.
    """
    raw = (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .schema(TEMPLATE_SCHEMA).csv(path)
        .select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"))
    )
    kept = raw.select(
        T.strip(T.or_empty(F.col("EventId"))).alias("event_id"),
        T.strip(T.or_empty(F.col("EventTemplate"))).alias("template"),
        "block",
    ).filter(F.col("template") != "")
    # the low 33 bits count the rows of a task; the least of a block is where the block begins
    numbered = kept.withColumn("_at", F.monotonically_increasing_id())
    blocks = numbered.groupBy("block").agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("block", "_start", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = numbered.join(offsets, "block")
    n = (F.col("_at") - F.col("_start") + F.col("_before")).cast("string")
    return placed.select(
        F.coalesce(F.nullif("event_id", F.lit("")), F.concat(F.lit("auto_"), n)).alias("event_id"), "template"
    )


def load_all_templates(
    spark: SparkSession, folder: str, files: Mapping[str, str] = TEMPLATE_FILES
) -> DataFrame:
    """Templates of every OS whose catalogue exists, one row per (os, event_id); the last one wins."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found: DataFrame | None = None
    for os, name in files.items():
        if fs.exists(hadoop_path(f"{folder}/{name}")):
            part = load_templates(spark, f"{folder}/{name}").select(
                F.lit(os).alias("os"), "event_id", "template", F.monotonically_increasing_id().alias("_v")
            )
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "os string, event_id string, template string")
    return upsert_latest(found, ["os", "event_id"], "_v").drop("_v")


def template_counts(templates: DataFrame) -> DataFrame:
    return templates.groupBy("os").agg(F.count(F.lit(1)).alias("n_templates"))
