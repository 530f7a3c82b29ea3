"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into a fixed number of blocks by a hash of their id. A source's target is a
number of whole passes over its blocks and a rest: blocks are put into a random order, whole ones are
drawn while they fit, and the block at the edge gives the documents before its first that does not fit. Single
documents, along the same order, close the gap until none that fits is left.
All draws together are the tickets of a tree: every node deals a random half of its tickets to each
child, which makes the sources' counts in a child multivariate hypergeometric, until each output shard
has an exact quota of every source. The shards then take disjoint stretches of each source's permuted
draws, and rows carry a random order inside their shard.

DataFrame operations only. Nothing is sorted that grows with a source: blocks and draws are bounded by
the number of sources. Only one block of each source is looked into, and then the documents that fit the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.session import checkpointed, inner_tables, kept

WORD = r"[^\x20\x09-\x0D]++"
#: Rows up to which the drawn blocks are broadcast to the documents; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Documents of a source that one step of closing the gap tries, the larger ones first.
POOL = 256

#: Rows of an output shard and of a block, from which their numbers (powers of two) follow; only one block of a
#: source is looked into by one task.
SHARD_ROWS, BLOCK_ROWS = 1 << 20, 1 << 16


def _next_power(rows: int, each: int, least: int) -> int:
    return max(least, 1 << (max(1, -(-rows // each)) - 1).bit_length())


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _block(doc_id: Column, seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), doc_id), F.lit(blocks)).cast("int")


def _place(doc_id: Column, seed: int) -> Column:
    """Place of a document inside its block."""
    return F.xxhash64(F.lit(seed), F.lit("place"), doc_id)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources (source, source_size): ``weights`` repeat over the sources by code point, null
    last; together the targets are ``share`` times all sizes; none passes ``most`` times its source.

    What a full source leaves over goes to the others by weight. Sources by their ratio of limit and
    weight fill up in that order, so one pass with running sums finds the level of those left open.
    One row per source takes part.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / open_weight).withColumn("order", F.row_number().over(fill))
    first_open = F.min(F.when(F.col("bound") > F.col("level") * F.col("weight"), F.struct("order", "level"))).over(everything)
    return (
        leveled.withColumn("open", first_open)
        .withColumn("target", F.coalesce(F.least("bound", F.col("open.level") * F.col("weight")), F.col("bound")))
        .select("source", "source_size", "target")
    )


def _ranks(rows: DataFrame, by: list[str], chance: Column) -> DataFrame:
    """Add ``rank`` (from 0) and ``total`` by ``chance`` within ``by``, a hundredth of a group in a task.

    Rows are ranked inside stretches of the random order, and the stretches have their counts summed.
    """
    dealt = checkpointed(rows.withColumn("chance", chance).withColumn("stretch", F.shiftright("chance", 57)))
    running = Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy(*by, "stretch").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
        .drop("n")
    )
    inside = Window.partitionBy(*by, "stretch").orderBy("chance", "ticket", "key")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(counts, [*by, "stretch"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .drop("chance", "stretch", "before", "place")
    )


def split_quotas(quotas: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """Tickets (key, ticket, shard) of quotas (key, quota): random halves at each node of a binary tree
    over ``shards`` (a power of two), so shard sizes differ by at most one per level."""
    assert shards > 0 and shards & (shards - 1) == 0, "shards is a power of two"
    tickets = quotas.filter("quota > 0").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("ticket"), F.lit(0).alias("shard"))
    level = 1
    while level < shards:
        ranked = _ranks(tickets, ["shard"], F.xxhash64(F.lit(seed), F.lit(level), F.col("key"), F.col("ticket")))
        right = (F.col("rank") * 2 >= F.col("total") + F.pmod(F.col("shard"), F.lit(2))).cast("int")
        tickets = ranked.select("key", "ticket", (F.col("shard") * 2 + right).alias("shard"))
        level *= 2
    return tickets


def _pool(units: DataFrame) -> DataFrame:
    """(key, block, place, size): of POOL random units of each source, the larger ones first, each that still fits."""
    chance = Window.partitionBy("key").orderBy(F.xxhash64("place"), "block", "place")
    pool = units.withColumn("number", F.row_number().over(chance)).filter(F.col("number") <= POOL)
    listed = pool.groupBy("key", "missing").agg(F.sort_array(F.collect_list(F.struct("size", "block", "place")), asc=False).alias("units"))
    none = F.struct(F.col("missing").alias("missing"), F.array().cast("array<struct<size:bigint,block:int,place:bigint>>").alias("picks"))
    fitted = F.aggregate(
        "units", none,
        lambda a, u: F.when(
            u["size"] <= a["missing"], F.struct((a["missing"] - u["size"]).alias("missing"), F.concat(a["picks"], F.array(u)).alias("picks"))
        ).otherwise(a),
    )
    return listed.select("key", F.inline(fitted["picks"])).select("key", "block", "place", "size")


def _along(units: DataFrame, permuted: Window) -> DataFrame:
    """(key, block, place, size): units along the permuted blocks, whole blocks while they fit, then part of one."""
    summed = (
        units.groupBy("key", "missing", "block").agg(F.sum("size").alias("block_size"))
        .withColumn("upto", F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("block_size"))
    )
    whole = units.join(summed.filter("upto <= missing").select("key", "block"), ["key", "block"], "left_semi")
    edge = units.join(summed.filter("upto > missing AND before < missing").select("key", "block", "before"), ["key", "block"])
    through = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy("place"))
    part = edge.withColumn("through", through).filter("through <= missing")
    return whole.select("key", "block", "place", "size").unionByName(part.select("key", "block", "place", "size"))


def _singles(sized: DataFrame, rest: DataFrame, missing: DataFrame, permuted: Window) -> DataFrame:
    """(key, block, place): documents that close the gap between what a source has given and its target.

    Units are the documents of one place. Steps over the pool and along the blocks take turns until
    none of the units left fits; units that do not fit any more are dropped in each step.
    """
    left = sized.filter("size > 0").join(rest, ["key", "block"]).join(missing, "key").filter(
        (F.col("block") != F.col("edge_block")) | F.col("edge_cut").isNull() | (F.col("place") > F.col("edge_cut"))
    )
    units = checkpointed(left.groupBy("key", "missing", "block", "place").agg(F.sum("size").alias("size")).filter("size <= missing"))
    found, unit = units.limit(0).select("key", "block", "place"), ["key", "block", "place"]
    by_pool = True
    while not units.isEmpty():
        picks = checkpointed(_pool(units) if by_pool else _along(units, permuted))
        found, by_pool = found.unionByName(picks.select(*unit)), not by_pool
        given = picks.groupBy("key").agg(F.sum("size").alias("given"))
        fitting = units.join(given, "key").withColumn("missing", F.col("missing") - F.col("given")).drop("given").filter("size <= missing")
        units = checkpointed(fitting.join(picks.select(*unit), unit, "left_anti"))
    return checkpointed(found)


def draw_blocks(sized: DataFrame, targets: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Draws (key, block, copy, shard, cut) and singles (key, block, place, copy, shard) of documents (key,
    block, place, size) and targets (key, source_size, target). ``cut`` is null for a whole block; else
    documents up to the place ``cut`` are drawn. Singles are drawn besides, those of a block to one shard."""
    with inner_tables(sized.sparkSession):
        plan = targets.filter("source_size > 0").select(
            "key", "source_size", "target", F.floor(F.col("target") / F.col("source_size")).cast("int").alias("passes")
        ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        blocks = sized.groupBy("key", "block").agg(F.sum("size").alias("block_size")).join(plan, "key")
        permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), F.col("key"), F.col("block")), "block")
        cumulated = checkpointed(
            blocks.withColumn("order", F.row_number().over(permuted))
            .withColumn("upto", F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)))
        )
        whole = F.col("upto") <= F.col("rest")
        edge = cumulated.filter(~whole & (F.col("upto") - F.col("block_size") < F.col("rest"))).select(
            "key", "block", (F.col("rest") - F.col("upto") + F.col("block_size")).alias("wanted")
        )
        # the documents of the edge blocks, one block for each source; equal places are taken together
        places = sized.join(edge, ["key", "block"]).groupBy("key", "block", "wanted", "place").agg(F.sum("size").alias("size"))
        through = F.sum("size").over(Window.partitionBy("key").orderBy("place"))
        cuts = checkpointed(
            places.withColumn("through", through).filter(F.col("through") <= F.col("wanted"))
            .groupBy("key", "block").agg(F.max("place").alias("cut"), F.max("through").alias("through"))
        )
        missing = edge.join(cuts, ["key", "block"], "left").select(
            "key", F.col("block").alias("edge_block"), F.col("cut").alias("edge_cut"), (F.col("wanted") - F.coalesce("through", F.lit(0))).alias("missing")
        )
        singles = _singles(sized, cumulated.filter(~whole).select("key", "block"), missing, permuted)
        none = F.lit(None).cast("long")

        def draw(rows: DataFrame, copy: Column, cut: Column = none, single: bool = False) -> DataFrame:
            return rows.select("key", "block", copy.alias("copy"), "order", cut.alias("cut"), F.lit(single).alias("single"))

        first = cumulated.filter("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        draws = checkpointed(
            draw(first, F.col("copy"))
            .unionByName(draw(cumulated.filter(whole), F.col("passes")))
            .unionByName(draw(cumulated.join(cuts, ["key", "block"]), F.col("passes"), F.col("cut")))
            .unionByName(draw(cumulated.join(singles, ["key", "block"], "left_semi"), F.col("passes"), single=True))
        )
        in_source = Window.partitionBy("key")
        numbered = draws.withColumn("number", F.row_number().over(in_source.orderBy("copy", "order", "single")) - 1)
        dealt = split_quotas(draws.groupBy("key").agg(F.count("*").alias("quota")), shards, seed)
        stretches = dealt.withColumn("number", F.row_number().over(in_source.orderBy("shard", "ticket")) - 1).select("key", "number", "shard")
        placed = kept(numbered.join(stretches, ["key", "number"]).select("key", "block", "copy", "shard", "cut", "single"))
        in_blocks = placed.filter("single").select("key", "block", "copy", "shard")
        return placed.filter("NOT single").drop("single"), kept(singles.join(in_blocks, ["key", "block"]))


class Mixture:
    """The draws of a mix and the helper columns that lead from a document to them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, source: str, shards: int | None, blocks: int | None, seed: int, **targets):
        rows = docs.count() if shards is None or blocks is None else 0
        shards, blocks = shards or _next_power(rows, SHARD_ROWS, 16), blocks or _next_power(rows, BLOCK_ROWS, 1024)
        self.doc_id, self.source, self.seed, self.blocks, self.shards = doc_id, source, seed, blocks, shards
        self.sized = checkpointed(
            docs.select(
                F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            ).select("*", _source_key(F.col("source")).alias("key"), _block(F.col("doc_id"), seed, blocks).alias("block"), _place(F.col("doc_id"), seed).alias("place"))
        )
        sizes = self.sized.groupBy("source", "key").agg(F.sum("size").alias("source_size"))
        with_targets = source_targets(sizes.select("source", "source_size"), **targets)
        self.targets = checkpointed(with_targets.withColumn("key", _source_key(F.col("source"))))
        self.draws, self.singles = draw_blocks(self.sized, self.targets, shards, seed)

    @staticmethod
    def _small(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    def rows(self, docs: DataFrame) -> DataFrame:
        """Every drawn copy of a document with all its columns, and ``mix_copy``, ``mix_shard`` and
        ``mix_order`` (random inside the shard), which replace columns of those names."""
        keyed = docs.withColumns({
            "_mix_key": _source_key(F.col(self.source)), "_mix_block": _block(F.col(self.doc_id), self.seed, self.blocks),
            "_mix_place": _place(F.col(self.doc_id), self.seed),
        })

        def named(rows: DataFrame) -> DataFrame:
            return self._small(rows).select(*[F.col(c).alias(f"_draw_{c}") for c in rows.columns])

        same = (F.col("_mix_key") == F.col("_draw_key")) & (F.col("_mix_block") == F.col("_draw_block"))
        met = (
            keyed.join(named(self.draws), same & (F.col("_draw_cut").isNull() | (F.col("_mix_place") <= F.col("_draw_cut")))).drop("_draw_cut")
            .unionByName(keyed.join(named(self.singles), same & (F.col("_mix_place") == F.col("_draw_place"))).drop("_draw_place"))
        )
        return met.select(
            *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("mix_copy", "mix_shard", "mix_order")], F.col("_draw_copy").alias("mix_copy"), F.col("_draw_shard").alias("mix_shard"),
            F.xxhash64(F.lit(self.seed), F.lit("shuffle"), F.col(self.doc_id), F.col("_draw_copy")).alias("mix_order"),
        )

    def in_shards(self, docs: DataFrame) -> DataFrame:
        """``rows`` dealt out by shard, each in its random order."""
        return self.rows(docs).repartitionById(self.shards, F.col("mix_shard")).sortWithinPartitions("mix_shard", "mix_order")

    def taken(self) -> DataFrame:
        """For each document: doc_id, size, source_size, target, taken (words of the copies that all shards take)
        and shards: ``shard:copies`` of each shard that takes some, comma-joined in their order."""
        whole = F.collect_list(F.when(F.col("cut").isNull(), F.col("shard")))
        per_block = self.draws.groupBy("key", "block").agg(
            whole.alias("whole"), F.max("cut").alias("cut"), F.max(F.when(F.col("cut").isNotNull(), F.col("shard"))).alias("cut_shard")
        )
        single = self._small(self.singles.select("key", "block", "place", F.col("shard").alias("single_shard")))
        met = self.sized.join(per_block, ["key", "block"], "left").join(single, ["key", "block", "place"], "left")
        none = F.array().cast("array<int>")
        copies = F.concat(
            F.coalesce("whole", none), F.when(F.col("place") <= F.col("cut"), F.array("cut_shard")).otherwise(none),
            F.when(F.col("single_shard").isNotNull(), F.array("single_shard")).otherwise(none),
        )
        given = met.withColumn("copies", F.array_sort(copies))
        shown = F.transform(F.array_distinct("copies"), lambda s: F.concat_ws(":", s.cast("string"), F.size(F.filter("copies", lambda x: x == s)).cast("string")))
        return given.join(F.broadcast(self.targets.drop("source")) if self.targets.count() <= BROADCAST_ROWS else self.targets.drop("source"), "key").select(
            "doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"), F.array_join(shown, ",").alias("shards")
        )


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, blocks: int | None = None, seed: int = 17,
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
) -> Mixture:
    """Plan a mix of all ``docs``; ``rows`` of the result gives its rows, ``taken`` what each document gives.

    A document's size is its number of words (null or empty text: 0). A null source is a source of its
    own. Documents of one id are drawn together, repeated rows included. A source without words has the
    target 0 and is not drawn from; a table without rows gives a mix without rows. Equal input gives an
    equal mix, whatever its partitions. ``shards`` and ``blocks`` follow from the number of rows unless given. A source falls short of its target by less than
    any document of its last pass that is not drawn.
    """
    return Mixture(docs, doc_id, text, source, shards, blocks, seed, weights=weights, share=share, most=most)
