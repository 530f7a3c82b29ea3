"""How document filters interact: what each removes in every order they can be applied in.

Four filters look at one text, the fifth at repeats of a text anywhere in the table. Repeats are found
behind a counting Bloom sketch: every text counts in PROBES cells of one bucket of cells, the tasks' partial
counts are added up, and a text with a cell that counts one is certainly unique. Only the other texts, the
possible repeats, are shuffled, for the exact smallest id of every text. All five verdicts of a document
are a mask of five bits; counts of masks are additive, and every figure of every order follows from them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from logweave.session import checkpointed

#: The filters, bit 0 first.
FILTERS = "ABCDE"
#: Cells of one bucket (a bitmap of Spark's size), cells each row gets on average, cells a text counts in.
BUCKET, CELLS_PER_ROW, PROBES = 32_768, 16, 4
#: Buckets at most: 128 MB once packed, the bound of what is broadcast. With more rows a bucket fills up, so
#: more unique texts count as possible repeats and are shuffled; no result changes.
MAX_BUCKETS = 32_768

_BLANKS = "[\\x20\\x09-\\x0D]+"


def with_failures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``bits``: the filters A to D that ``text`` fails.

    A: under 200 words; B: under half of the words distinct; C: over 3 % of the code points in A-Z;
    D: any of ``#$%&*|``. A null text is empty, words are runs of non-blanks.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sized = docs.withColumn("_words", F.array_remove(F.split(whole, _BLANKS), "")).withColumns({"_n": F.size("_words"), "_distinct": F.size(F.array_distinct("_words"))})
    upper = F.octet_length(F.regexp_replace(whole, "[^A-Z]+", ""))
    checks = [F.col("_n") < 200, 100 * F.col("_distinct") < 50 * F.col("_n"), 100 * upper > 3 * F.length(whole), whole.rlike("[#$%&*|]")]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(checks)), F.lit(0))
    return sized.withColumn("bits", bits).drop("_words", "_n", "_distinct")


def _cells(key: Column) -> list[Column]:
    """Cells of a key in its bucket; they may coincide, which only lets more texts pass as possible repeats."""
    spread = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.shiftrightunsigned(spread, 15 * i), F.lit(BUCKET)).cast("int") for i in range(PROBES)]


def counting_sketch(docs: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, often): a bitmap of the cells that count two or more texts, at most ``buckets`` rows.

    Partial counts of a task are added before the shuffle, so copies of one text cost it one count a cell.
    """
    key = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    counts = (
        docs.select(key.alias("key")).select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), F.explode(F.array_distinct(F.array(*_cells(F.col("key"))))).alias("cell"))
        .groupBy("bucket", "cell").agg(F.count("*").alias("n"))
    )
    return counts.filter("n > 1").groupBy("bucket").agg(F.bitmap_construct_agg(F.col("cell").cast("long")).alias("often"))


def _set_in(bitmap: Column, cell: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), cell.bitwiseAND(7) + 1)) != 0


def with_possible_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``repeats``: false only where no other row has the same text."""
    rows = docs.count()
    buckets = min(MAX_BUCKETS, max(1, -(-rows * CELLS_PER_ROW // BUCKET)))
    sketch = checkpointed(counting_sketch(docs, buckets, text))
    key = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    keyed = docs.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int"))
    met = keyed.join(F.broadcast(sketch.select(F.col("bucket").alias("_bucket"), F.col("often").alias("_often"))), "_bucket", "left")
    hit = F.lit(True)
    for cell in _cells(F.col("_key")):
        hit = hit & _set_in(F.col("_often"), cell)
    return met.withColumn("repeats", F.col("_often").isNotNull() & hit).drop("_key", "_bucket", "_often")


def flag_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of a part fail which filters, and their labels.

    E fails where a row with a smaller id has the same text; null texts are empty. A row without an id
    neither fails E nor makes others fail it, and has no label; rows of one id and one text are alike, and none is
    smaller than the other. A label counts if any label row of the id says so. A null part is the empty string.
    """
    docs = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part")
    )
    judged = with_possible_repeats(docs)
    digest = F.md5("text")
    # the smallest id of every text that may repeat; copies meet before the shuffle
    firsts = (
        judged.filter("repeats and doc_id is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
        .select("doc_id", digest.alias("digest"), F.lit(True).alias("first"))
    )
    slim = checkpointed(
        with_failures(judged).select("doc_id", "part", "bits", F.when(F.col("repeats") & F.col("doc_id").isNotNull(), digest).alias("digest"))
        .groupBy("doc_id", "part", "bits", "digest").agg(F.count("*").alias("n"))
    )
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    known = slim.filter("doc_id is not null").join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    mask = F.col("bits") + F.when(F.col("digest").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    rows = known.select("part", mask.alias("mask"), "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).unionByName(
        slim.filter("doc_id is null").select("part", F.col("bits").alias("mask"), "n", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    )
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def audit_orders(masks: DataFrame) -> DataFrame:
    """Every figure of every part, order and step, from the counts of ``flag_filters``.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    A mask is at most 32 rows of a part; no documents are read. Without rows there is no part and no result.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = masks.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    before = bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    own = bits(F.substring("filter_order", F.col("step"), F.lit(1)))
    seen = steps.withColumns({"before": before, "own": own})
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone
    # of all orders, the filter comes first among those that a mask fails in one of as many as it fails
    share = F.lit(factorial(len(FILTERS))) / F.bit_count("mask")

    def total(when: Column, what: Column) -> Column:
        return F.sum(F.when(when, what).otherwise(F.lit(0))).cast("long")

    n = F.col("n")
    return seen.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, n).alias("kept"), total(removed, n).alias("removed"), total(fails & gone, n).alias("redundant"), total(F.col("mask") == F.col("own"), n).alias("unique_fails"),
        total(removed, F.col("good")).alias("good_lost"), total(removed, F.col("toxic")).alias("toxic_lost"), total(fails, n * share.cast("long")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters over all documents: see ``flag_filters`` for the rows and ``audit_orders`` for the figures."""
    return audit_orders(checkpointed(flag_filters(docs, labels, doc_id, text, part)))
