import random

import pytest
from llm_rows import prose
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns of documents, and some whose names the operators use inside.
SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
    *(StructField(c, StringType()) for c in ("n_tokens", "secrets", "pii", "node", "bucket", "key", "size", "pattern", "quality", "n_words", "text_hash", "kept", "seed")),
])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties of ids."""
    rng = random.Random(5)
    same = prose(rng, 60)
    texts = [
        (1, ""), (2, None), (None, same), (None, None), (3, "word"), (4, " \n\t  "), (5, same), (5, same), (5, prose(rng, 40)), (6, "x" * 30_000),
        (7, prose(rng, 30_000)), (8, "Ünïcödé 日本語 𐍈 <|endoftext|> ok\x00\n\n\nend "), (9, "a b  c   d　e\x1cf " * 5), (10, same + " more"), (11, "0" * 5_000 + " " + "1-" * 900),
    ]
    return [(i, t, None, (None, "a", "b", "c")[k % 4], None, *(["x"] * 13)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
