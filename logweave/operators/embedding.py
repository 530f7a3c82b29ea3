"""Text to vectors. The default embedder hashes tokens; any callable can take its place."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from logweave.functions.text import let
from logweave.functions.vectors import unit

DIMENSIONS = 64
BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def embed_text(
    df: DataFrame,
    text: str,
    out: str = "embedding",
    embedder: Embedder | None = None,
    dimensions: int = DIMENSIONS,
    normalize: bool = True,
) -> DataFrame:
    """Add ``out``: array<double> of the text; null text counts as empty.

    A user embedder is called once per Arrow batch. The default counts hashed tokens in one projection.
    """
    filled = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    if embedder is not None:
        made = filled.withColumn(out, _call(embedder)(F.col("_text")))
        if normalize:
            made = made.withColumn(out, unit(F.col(out)))
        return made.drop("_text")
    made = filled.withColumn("_buckets", token_buckets(F.col("_text"), dimensions))
    return made.withColumn(out, bucket_counts(F.col("_buckets"), dimensions, normalize)).drop("_text", "_buckets")


def bucket_counts(buckets: Column, dimensions: int = DIMENSIONS, normalize: bool = True) -> Column:
    """How often each dimension stands in ``buckets``, to length 1 where ``normalize`` says so.

    The work follows the dimensions that occur; the zeros between them are filled in as runs.
    """
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)

    def count(d: Column) -> Column:
        return F.struct(d.alias("d"), (F.size(buckets) - F.size(F.array_remove(buckets, d))).cast("double").alias("n"))

    def filled(found: Column, length: Column) -> Column:
        before = lambda i: F.coalesce(F.get(found, i - 1)["d"], F.lit(-1)) + 1
        runs = F.transform(found, lambda x, i: F.concat(zeros(x["d"] - before(i)), F.array(x["n"] / length)))
        return F.flatten(F.concat(runs, F.array(zeros(F.lit(dimensions) - before(F.size(found))))))

    def sized(found: Column) -> Column:
        if not normalize:
            return filled(found, F.lit(1.0))
        return let(F.sqrt(F.aggregate(found, F.lit(0.0), lambda s, x: s + x["n"] * x["n"])), lambda length: filled(found, length))

    return let(F.transform(F.array_sort(F.array_distinct(buckets)), count), sized)


def token_buckets(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The dimension of every token, by the first eight hex digits of its md5; tokens are runs of non-blanks, lower case."""
    tokens = F.array_remove(F.split(F.lower(text), BLANKS), "")
    return F.transform(tokens, lambda t: F.pmod(F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int"))


def _call(embedder: Embedder):
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in embedder(texts.tolist())])

    return run


def embed_distinct(
    df: DataFrame, by: Sequence[str], text: str, embedder: Embedder | None = None
) -> DataFrame:
    """One embedded row per distinct (by, text): templates repeat, so few texts are embedded."""
    distinct = df.select(*by, text).distinct()
    return embed_text(distinct, text, embedder=embedder)
