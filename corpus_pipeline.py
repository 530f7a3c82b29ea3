"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, token ids.

``run`` hands each stage's rows on as a Parquet table in the shared folder, so a lost executor costs a
stage at most; what a stage has written besides goes when its table is whole. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontamination, mixing, near_duplicates, quality, token_files
from logweave.session import fresh_path, inner_tables, kept, use_utc


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting quality rules keep."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: 5-word shingles, similarity 0.8 or more."""
    return near_duplicates.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with inner_tables(spark):
        leaks = kept(decontamination.find_leaks(docs, items))
    return decontamination.drop_leaks(docs, leaks)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, dealt to output shards and shuffled in them: a document drawn twice is two rows."""
    return mixing.mix_sources(docs).in_shards(docs).select(*docs.columns)


def token_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and what they hold for each: doc_id, start, n_tokens, ids_crc32."""
    folder = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", token_rows),
]

#: The estimates of the quality stage and the hashes of the others have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = use_utc(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with inner_tables(spark):
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
