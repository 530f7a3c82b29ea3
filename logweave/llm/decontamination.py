"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words in a window and ignore the others, so two passages that differ in a
few words still share seeds. Seeds of the documents are joined with seeds of the benchmark; each hit
gives a shift between a document and an item, and along that shift the words are compared: a document
is contaminated if in some stretch of the item enough words are equal. The masks leave no placement of the allowed changes
out, so every passage that the rule accepts has a hit. DataFrame operations only.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from logweave.session import checkpointed

#: Ones are compared, zeros ignored. Any 10 equal words of 13 hold one of them.
MASKS = ("111011", "1100001011", "110111")
#: Words that an added mask compares, its length, and the placements up to which masks are sought one by one.
WEIGHT, SPAN, PLACEMENTS = 5, 13, 20_000
#: Words of a stretch, and the share of them that must be equal (an item below that length: all of it).
STRETCH, SHARE = 13, 0.75
#: Items with fewer words match only where all their words stand in a row.
LEAST_WORDS = 6
#: Scripts without blanks between words (Thai to Myanmar, Khmer, kana, Han); a character is a word.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: Benchmark seeds up to which they are broadcast (24 bytes each); beyond, both sides are shuffled.
BROADCAST_SEEDS = 2_000_000


@lru_cache
def covering(n: int, changes: int, masks: tuple[str, ...] = ()) -> tuple[str, ...]:
    """``masks``, and more of them until ``n`` words always share a seed with themselves after ``changes``
    of them, wherever those stand, are replaced."""
    run = "1" * math.ceil((n - changes) / (changes + 1))  # the longest run that stays whole has as many words
    if math.comb(n, changes) > PLACEMENTS:
        return (*masks, run)

    def hits(mask: str, changed: int) -> bool:
        return any((int(mask, 2) << at) & changed == 0 for at in range(n - len(mask) + 1))

    weight = min(WEIGHT, n - changes)
    spans = [s for s in range(weight, min(n, SPAN) + 1) if weight > 1 or s == 1]
    more = ["".join("1" if k in (0, s - 1, *inner) else "0" for k in range(s)) for s in spans for inner in combinations(range(1, s - 1), max(weight - 2, 0))]
    # each word's place is a bit, the first word's the highest
    missed = {c for c in (sum(1 << k for k in places) for places in combinations(range(n), changes)) if not any(hits(m, c) for m in masks)}
    found = {m: {c for c in missed if hits(m, c)} for m in more} if missed else {}
    while missed:
        best = max(more, key=lambda m: len(found[m] & missed))
        if not found[best] & missed:
            return (*masks, run)
        masks, missed = (*masks, best), missed - found[best]
    return masks


def _words(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, lower case; of an unspaced script single characters."""
    word = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]++|[\p{{L}}\p{{N}}]"
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0))
    return F.transform(found, lambda w: F.xxhash64(w))


def _seeds(words: Column, masks: tuple[str, ...]) -> Column:
    """(seed, at) of every window and mask; a mask has the same seeds whatever stands beside it."""

    def of(mask: str) -> Column:
        places = [k for k, c in enumerate(mask) if c == "1"]
        starts = F.when(F.size(words) >= len(mask), F.sequence(F.lit(0), F.size(words) - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(F.xxhash64(F.lit(mask), *[F.get(words, at + k) for k in places]).alias("seed"), at.alias("at")))

    return F.flatten(F.array(*[of(m) for m in masks]))



def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    masks: tuple[str, ...] = MASKS, stretch: int = STRETCH, share: float = SHARE, least_words: int = LEAST_WORDS, broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """Contaminated documents with their items: doc_id, text_hash, item_id, shift, equal (words equal in
    the best stretch), one row for each document, item and shift that hold.

    A document is its id and text: ``text_hash`` is the xxhash64 of the text, null as empty; repeated
    rows count once. Items without a word match nothing, those below ``least_words`` match where all their words
    stand in a row. Masks are added
    to ``masks`` where those leave out a placement of the changes that ``share`` allows. Insertions move
    the shift: the parts before and after one count on their own. Empty tables give no rows.
    """
    items = checkpointed(
        benchmark.select(F.col(item_id).alias("item_id"), _words(F.col(item_text)).alias("item_words")).filter(F.size("item_words") > 0)
        .withColumn("n", F.size("item_words"))
    )
    # masks for each length of a stretch that occurs, at most ``stretch`` of them; short items have one of all their words
    widths = sorted((w for (w,) in items.select(F.least(F.col("n"), F.lit(stretch))).distinct().collect()), reverse=True)
    every = masks
    for width in (w for w in widths if w >= least_words):
        every = covering(width, width - math.ceil(width * share), every)
    whole = tuple("1" * w for w in widths if w < least_words)
    seeds_of = F.when(F.col("n") >= least_words, _seeds(F.col("item_words"), every))
    for mask in whole:
        seeds_of = seeds_of.when(F.col("n") == len(mask), _seeds(F.col("item_words"), (mask,)))
    item_seeds = checkpointed(items.select("item_id", F.explode(seeds_of).alias("s")).select("item_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at")))
    every = tuple(dict.fromkeys((*every, *whole)))
    if item_seeds.count() <= broadcast_seeds:
        item_seeds = F.broadcast(item_seeds)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    doc_seeds = keyed.select("doc_id", "text_hash", _words(F.col("text")).alias("words")).select(
        "doc_id", "text_hash", F.explode(_seeds(F.col("words"), every)).alias("s")
    ).select("doc_id", "text_hash", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    hits = checkpointed(
        doc_seeds.join(item_seeds, "seed").select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    )
    # compare along the shift; the text is fetched once for each document that was hit
    hit_docs = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    texts = keyed.join(hit_docs, _same(F.col("doc_id"), F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left_semi")
    words = texts.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("word_id"), F.col("text_hash").alias("word_hash"), _words(F.col("text")).alias("words"))
    met = hits.join(words, _same(F.col("doc_id"), F.col("word_id")) & (F.col("text_hash") == F.col("word_hash"))).join(
        items.withColumnRenamed("item_id", "known_id"), _same(F.col("item_id"), F.col("known_id"))
    )
    # 1 where the item's word stands in the document at its shifted place; places outside count 0
    equal = F.transform(
        F.col("item_words"), lambda w, i: F.when((i + F.col("shift") >= 0) & (F.get(F.col("words"), i + F.col("shift")) == w), 1).otherwise(0)
    )
    width = F.least(F.col("n"), F.lit(stretch))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda b: F.aggregate(F.slice(F.col("equal"), b, width), F.lit(0), lambda a, x: a + x)))
    enough = F.when(F.col("n") < least_words, F.col("n")).otherwise(F.ceil(width * F.lit(share)))
    return (
        met.withColumn("equal", equal).withColumn("best", best).filter(F.col("best") >= enough)
        .select("doc_id", "text_hash", "item_id", "shift", F.col("best").alias("equal"))
    )


def drop_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that have no leak, all columns as they are."""
    found = leaks.select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    met = F.col(f"`{doc_id}`").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == F.col("_leak_hash"))
    return docs.join(found, met, "left_anti")


def mark_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_items (long), items (their ids by size, comma-joined), kept (no item)."""
    found = leaks.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("found")).select(
        F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash"), "found"
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_leak_id")) & (F.col("text_hash") == F.col("_leak_hash")), "left")
    return met.select(
        "doc_id", F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_items"),
        F.coalesce(F.array_join("found", ","), F.lit("")).alias("items"), F.col("found").isNull().alias("kept"),
    )
