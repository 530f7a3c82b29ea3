"""Exact nearest neighbours within a group (an OS), and whether an earlier row is near.

Pairs are never written out: at most ``k`` rows per query leave a task. Items that fit a fixed byte bound
(checked before they are sent) are broadcast, and the queries are not shuffled at all. Beyond that a group
is cut into blocks of items around pivots. A query first visits the block of its nearest pivot; the
distance of its k-th neighbour there, or the limit, tells which other blocks can hold a nearer one, and it is
copied to those alone. Inside a block, and for broadcast items, cells around pivots are visited in the order of
their bounds (``cells``). Every cut gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.operators import cells as X, tiles as T
from logweave.session import checkpointed

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 50_000
DIGITS = X.DIGITS
#: Pivots of one block of items, and of all blocks together: the bound of what the driver holds.
BLOCK_PIVOTS, PIVOTS = 8, 4096
#: Queries of a block that one task answers; a block that more queries visit is copied to several tasks.
SHARE_ROWS = 50_000
#: Blocks that a group is cut into while they stay below BLOCK_ROWS: a query is copied to so many at most, however small ``block_rows`` is.
GROUP_BLOCKS = 16
_BATCH = 2048
#: Leaders of a group that one task compares with as many others, and tasks at most that the pairs of such tiles are dealt over.
TILE_ROWS, TILE_TASKS = 24_576, 2_000
#: (query, block) pairs that routing looks at in one go: the bound of its memory.
_PAIRS = 1 << 17

_matrix, _unit_rows = X.matrix, X.unit_rows


class Search(NamedTuple):
    """What is asked of the items: the ``k`` nearest within ``limit``, or (``k`` 0) an earlier one within it."""

    k: int
    limit: float = 2.0


class Sorted(NamedTuple):
    """Items in the order that ties are broken by, as arrays: far smaller than a data frame with an object for each vector."""

    ids: np.ndarray
    at: np.ndarray | None
    rows: np.ndarray


def _sorted(items: pd.DataFrame, search: Search) -> Sorted:
    by = ["item_id"] if search.k else ["item_at", "item_id"]
    items = items.sort_values(by, kind="stable")
    return Sorted(items["item_id"].to_numpy(), None if search.k else items["item_at"].to_numpy(), _unit_rows(_matrix(items["vector"])))


class Held:
    """The items of a group or block in the order of their ids, or of (at, id) where an earlier one is asked for."""

    def __init__(self, items: Sorted, search: Search):
        self.ids = items.ids
        self.places = None if search.k else list(zip(items.at, items.ids, strict=True))
        self.index = X.CellIndex(items.rows)
        self.search = search

    def answer(self, asks: pd.DataFrame) -> pd.DataFrame:
        parts = [self._answer(asks.iloc[at : at + _BATCH]) for at in range(0, len(asks), _BATCH)]
        return pd.concat(parts) if parts else asks.iloc[:0]

    def _answer(self, asks: pd.DataFrame) -> pd.DataFrame:
        queries = _unit_rows(_matrix(asks["vector"]))
        if not self.search.k:
            before = np.array([bisect_left(self.places, p) for p in zip(asks["query_at"], asks["query_id"], strict=True)], np.int64)
            hit = self.index.any_before(queries, before, self.search.limit)
            return asks.loc[hit, ["query_id", "grp"]]
        best = self.index.nearest(queries, self.search.k, self.search.limit)
        r, c = np.nonzero(best != X.NONE)
        keys = best[r, c]
        return pd.DataFrame(
            {"query_id": asks["query_id"].to_numpy()[r], "grp": asks["grp"].to_numpy()[r], "item_id": self.ids[keys & 0xFFFFFFFF], "distance": (keys >> 32) / X.STEPS}
        )

    def counted(self, compared: Accumulator | None) -> None:
        if compared is not None:
            compared.add(self.index.compared)
        self.index.compared = 0


def _usable(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    chosen = rows.select(*[F.col(old).alias(new) for new, old in names.items()])
    filled = "length" if chosen.schema["vector"].dataType.simpleString() == "binary" else "size"
    return chosen.filter(f"vector IS NOT NULL AND {filled}(vector) > 0 AND grp IS NOT NULL")


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str,
    item_id: str,
    by: str = "os",
    query_vector: str = "embedding",
    item_vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    limit: float = 2.0,
    compared: Accumulator | None = None,
) -> DataFrame:
    """Rows (query_id, by, item_id, distance, rank), ranked by (distance, item id).

    Distance is 1 - cosine, rounded to six digits; items farther than ``limit`` do not count. Rows without a
    vector take no part. ``compared`` adds up the pairs whose distance was computed.
    """
    q = _usable(queries, {"query_id": query_id, "grp": by, "vector": query_vector})
    i = _usable(items, {"item_id": item_id, "grp": by, "vector": item_vector})
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, grp string, item_id {i.schema['item_id'].dataType.simpleString()}, distance double"
    found = _search(q, i, Search(k, limit), schema, broadcast_bytes, block_rows, compared)
    w = Window.partitionBy("query_id", "grp").orderBy("distance", "item_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        F.col("query_id").alias(query_id),
        F.col("grp").alias(by),
        F.col("item_id").alias(item_id if item_id != query_id else f"near_{item_id}"),
        "distance",
        "rank",
    )


def with_earlier_near(
    rows: DataFrame, limit: float, by: str = "os", broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = BLOCK_ROWS, compared: Accumulator | None = None
) -> DataFrame:
    """(by, id, near, distance) of the rows (by, id, at, embedding) with another row before them, in the order of (at, id), within ``limit``.

    Rows of ``in_order`` are known by their place: ``near`` is the place of one such row, null if it was not kept.
    """
    place = "place" if "place" in rows.columns else "id"
    q = _usable(rows, {"query_id": place, "grp": by, "vector": "embedding", "query_at": "place" if place == "place" else "at"})
    if _bytes(q) <= broadcast_bytes:
        i = q.withColumnsRenamed({"query_id": "item_id", "query_at": "item_at"})
        schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, grp string"
        found = _search_broadcast(q, i, Search(0, limit), schema, compared)
        found = found.distinct().select("grp", "query_id", F.lit(None).cast("bigint").alias("near"), F.lit(None).cast("double").alias("distance"))
    elif place == "place":
        found = earlier_near(q.select("grp", F.col("query_id").alias("place"), "vector"), limit, block_rows, compared).withColumnRenamed("place", "query_id")
    else:
        kept = in_order(rows.select(by, "id", "at", "embedding"), by)
        found = earlier_near(kept.select(F.col(by).alias("grp"), "place", F.col("embedding").alias("vector")), limit, block_rows, compared)
        found = found.join(kept.select("place", F.col("id").alias("query_id")), "place")
    return found.select(F.col("grp").alias(by), F.col("query_id").alias("id"), "near", "distance").distinct()


def in_order(rows: DataFrame, by: str = "os") -> DataFrame:
    """Usable rows (by, id, at, embedding) with their ``place`` in the order of (by, at, id), and the vector as the packed unit one."""
    usable = rows.filter(F.col(by).isNotNull() & (F.size("embedding") > 0)).select(F.col(by).cast("string").alias(by), "id", "at", F.col("embedding").cast("array<double>").alias("embedding"))
    # written before they are sorted: the bounds of the sort are found by reading the rows once more
    ready = checkpointed(packed(usable, "embedding"))
    # the number of a row grows with its partition and its place there
    return checkpointed(ready.repartitionByRange(by, "at", "id").sortWithinPartitions(by, "at", "id").withColumn("place", F.monotonically_increasing_id()))


def packed(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with their vector, which must not be null, as the bytes of the unit vector."""
    if rows.schema[vector].dataType.simpleString() == "binary":
        return rows
    rows = rows.withColumn(vector, F.col(vector).cast("array<double>"))
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == vector else f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit_rows(batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield batch.set_column(at, vector, _packed(unit + 0.0))  # no negative zero: equal vectors are equal bytes

    return rows.mapInArrow(run, schema)


def _packed(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(rows: DataFrame) -> int:
    size = F.length("vector") if rows.schema["vector"].dataType.simpleString() == "binary" else F.size("vector") * F.lit(8)
    return rows.agg(F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()[0]


def _search(q: DataFrame, i: DataFrame, search: Search, schema: str, broadcast_bytes: int, block_rows: int, compared: Accumulator | None) -> DataFrame:
    if _bytes(i) <= broadcast_bytes:
        return _search_broadcast(q, i, search, schema, compared)
    return _search_blocks(q, i, search, schema, block_rows, compared)


def _search_broadcast(q: DataFrame, i: DataFrame, search: Search, schema: str, compared: Accumulator | None) -> DataFrame:
    collected = i.toPandas()  # size checked by the caller
    # the index itself is sent: a worker that built it from the items would hold them twice, and build it for every task
    shared = q.sparkSession.sparkContext.broadcast({g: Held(_sorted(part, search), search) for g, part in collected.groupby("grp")} if len(collected) else {})
    del collected

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                held = shared.value.get(g)
                if held is not None:
                    yield held.answer(part)
                    held.counted(compared)

    return q.mapInPandas(run, schema)


class Layout(NamedTuple):
    """How one group is cut: its pivots, and for each cell its pivot, bounds, and first block and number of blocks."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    block: np.ndarray
    parts: np.ndarray


def _chance(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("pivot")), 11) / F.lit(float(1 << 53))


def _pivots(i: DataFrame, block_rows: int) -> dict[str, np.ndarray]:
    """Pivots of the groups that need more than one block: about BLOCK_PIVOTS a block, PIVOTS in all, one at least."""
    sizes = checkpointed(i.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return {}
    rate = min(BLOCK_PIVOTS / block_rows, PIVOTS / total)
    rows = i.join(sizes.select("grp"), "grp", "left_semi").select("grp", "vector", _chance(F.col("item_id")).alias("chance"))
    chosen = rows.filter(F.col("chance") < rate).select("grp", "vector").unionByName(rows.groupBy("grp").agg(F.min_by("vector", "chance").alias("vector")))
    return {g: _distinct(part["vector"]) for g, part in chosen.toPandas().groupby("grp")}


def _distinct(vectors: pd.Series) -> np.ndarray:
    rows = _matrix(vectors)
    found = X.distinct_rows(_unit_rows(rows))
    return found if len(found) else np.eye(1, rows.shape[1])  # a group of zero vectors


def _rows_of_a_block(n: int, block_rows: int) -> int:
    """Rows of the blocks of a group of ``n``: ``block_rows``, or as many as make GROUP_BLOCKS blocks, up to BLOCK_ROWS."""
    return max(block_rows, min(BLOCK_ROWS, -(-n // GROUP_BLOCKS)))


def _layouts(stats: pd.DataFrame, pivots: dict[str, np.ndarray], least: int) -> dict[str, Layout]:
    """Cells packed into blocks of at most ``_rows_of_a_block``, near ones together; a larger cell has blocks of its own."""
    out = {}
    for g, cells in stats.groupby("grp"):
        block_rows = _rows_of_a_block(int(cells["n"].sum()), least)
        p = pivots[g]
        landmarks = p[:: max(1, len(p) // 16)]
        side, far = X.nearest_pivot(p, landmarks)
        key = [(-1, 0.0) if c < 0 else (int(side[c]), float(far[c])) for c in cells["cell"]]
        cells = cells.iloc[sorted(range(len(cells)), key=key.__getitem__)]
        block, parts, at, filled = [], [], 0, 0
        for n in cells["n"]:
            if filled and filled + n > block_rows:
                at, filled = at + 1, 0
            block.append(at)
            parts.append(max(1, -(-int(n) // block_rows)))
            filled += n
            if parts[-1] > 1:
                at, filled = at + parts[-1], 0
        out[g] = Layout(p, *[cells[c].to_numpy() for c in ("cell", "low", "high")], np.array(block), np.array(parts))
    return out


def _route(q: DataFrame, layouts, limit: float, home: bool) -> DataFrame:
    """Copies of queries (query_id, grp, vector, reach[, query_at]) with the block they go to: the one of the nearest
    pivot (``home``), or all others that can hold an item within ``reach``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields) + ", block int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                layout = layouts.value.get(g)
                if layout is None:
                    if home:  # a small group is one block
                        yield part.assign(block=0)
                    continue
                begin = np.flatnonzero(np.diff(layout.block, prepend=-1))  # the first cell of each block, or of a cell's own blocks
                step = max(1, min(_BATCH, _PAIRS // len(layout.block)))
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    bounds = X.lower_bounds(_unit_rows(_matrix(some["vector"])), layout.pivots, layout.pivot, layout.low, layout.high)
                    first = layout.block[bounds.argmin(axis=1)]
                    if home:
                        yield some.assign(block=first)
                        continue
                    reach = np.minimum(some["reach"].to_numpy(), limit) + X._MARGIN
                    row, c = np.nonzero(np.minimum.reduceat(bounds, begin, axis=1) <= reach[:, None])
                    parts = layout.parts[begin[c]]
                    row = np.repeat(row, parts)
                    block = np.repeat(layout.block[begin[c]], parts) + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    other = np.flatnonzero(block != first[row])
                    for cut in range(0, len(other), _BATCH):  # copies hold their vector each
                        few = other[cut : cut + _BATCH]
                        yield some.iloc[row[few]].assign(block=block[few])

    return q.mapInPandas(run, schema)


def _visit(q: DataFrame, i: DataFrame, search: Search, schema: str, compared: Accumulator | None) -> DataFrame:
    """Answers of the blocks of items (grp, block) to the copies of queries that came to them."""
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = checkpointed(q)
    visits = checkpointed(routed.groupBy("grp", "block").agg(F.count("*").alias("visits")))
    total = visits.agg(F.coalesce(F.sum("visits"), F.lit(0))).first()[0]
    share = max(1, min(SHARE_ROWS, -(-total // tasks)))
    # a block that many queries visit is copied, so that no task answers more than a share of them
    shares = visits.select("grp", "block", F.ceil(F.col("visits") / share).cast("int").alias("shares"))
    none = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
    asked = [f for f in routed.schema.fields if f.name.startswith("query_")]
    held = [f for f in i.schema.fields if f.name.startswith("item_")]
    left = i.join(shares, ["grp", "block"]).select(
        "grp", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"), "vector", *[none(f) for f in asked], *[f.name for f in held]
    )
    right = routed.join(shares, ["grp", "block"]).select(
        "grp", "block", F.pmod(F.xxhash64("query_id"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("side"), "vector", *[f.name for f in asked], *[none(f) for f in held]
    )
    both = left.unionByName(right).repartition(tasks, "grp", "block", "share").sortWithinPartitions("grp", "block", "share", "side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, waiting, ready = None, [], None
        for batch in batches:
            for now, part in batch.groupby(["grp", "block", "share"]):
                if now != key:
                    key, waiting, ready = now, [], None
                items, asks = part[part["side"] == 0], part[part["side"] == 1]
                if len(items):
                    waiting.append(items)
                if len(asks) and (waiting or ready):
                    ready, waiting = ready or Held(_sorted(pd.concat(waiting), search), search), []
                    yield ready.answer(asks)
                    ready.counted(compared)

    return both.mapInPandas(run, schema)


def _search_blocks(q: DataFrame, i: DataFrame, search: Search, schema: str, block_rows: int, compared: Accumulator | None) -> DataFrame:
    spark = q.sparkSession
    i = checkpointed(i)
    pivots = _pivots(i, block_rows)
    shared = spark.sparkContext.broadcast(pivots)
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in i.schema.fields) + ", cell int, far double"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                cell, far = X.nearest_pivot(_unit_rows(_matrix(part["vector"])), shared.value[g]) if g in shared.value else (0, 0.0)
                yield part.assign(cell=cell, far=far)

    placed = checkpointed(i.mapInPandas(place, held))
    large = spark.createDataFrame([(g,) for g in pivots], "grp string")
    stats = placed.join(F.broadcast(large), "grp", "left_semi").groupBy("grp", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    layouts = _layouts(stats.orderBy("grp", "cell").toPandas(), pivots, block_rows)  # a row for each pivot
    rows = [(g, int(c), int(b), int(n)) for g, x in layouts.items() for c, b, n in zip(x.pivot, x.block, x.parts, strict=True)]
    cut = F.broadcast(spark.createDataFrame(rows, "grp string, cell int, block int, parts int"))
    block = F.coalesce(F.col("block") + F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int"), F.lit(0))
    blocks = placed.join(cut, ["grp", "cell"], "left").withColumn("block", block).drop("cell", "far", "parts")
    ways = spark.sparkContext.broadcast(layouts)
    at_home = checkpointed(_visit(_route(q, ways, search.limit, True), blocks, search, schema, compared))
    if not layouts:
        return at_home
    kth = at_home.groupBy("query_id", "grp").agg(F.count("*").alias("n"), F.max("distance").alias("reach")).filter(F.col("n") >= search.k).drop("n")
    open_ = q.join(kth, ["query_id", "grp"], "left").withColumn("reach", F.coalesce("reach", F.lit(float(search.limit))))
    order = [f.name for f in q.schema.fields]
    return at_home.unionByName(_visit(_route(open_.select(*order, "reach"), ways, search.limit, False), blocks, search, schema, compared))


def earlier_near(rows: DataFrame, limit: float, block_rows: int = BLOCK_ROWS, compared: Accumulator | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(grp, place, near, distance) of the rows (grp, place, vector packed) with an earlier place within ``limit``; ``near`` is one.

    Rows are cut into cells around pivots. In a cell a row far nearer than the limit to an earlier one follows it, the others lead.
    Leaders that are near no earlier leader of their cell are compared with all earlier leaders of their group, tile by tile;
    where a follower of one of these can be near, its own distance tells.
    """
    spark = rows.sparkSession
    pivots = _pivots(rows.withColumnRenamed("place", "item_id"), block_rows)
    shared = spark.sparkContext.broadcast({g: (p, T.axes(p)) for g, p in pivots.items()})

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cell = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32)
            for g in set(names) & shared.value.keys():
                some = np.flatnonzero(names == g)
                cell[some] = X.nearest_pivot(_matrix(batch.column(2).take(pa.array(some)).to_pylist()), shared.value[g][0])[0]
            yield batch.append_column("cell", pa.array(cell))

    rows = rows.select("grp", "place", "vector")
    placed = checkpointed(rows.mapInArrow(cells, "grp string, place bigint, vector binary, cell int"))
    parts = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")).filter("parts > 1")
    cut = placed.join(F.broadcast(checkpointed(parts)), ["grp", "cell"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"), F.lit(0)))

    def led(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        m = _matrix(pdf["vector"])
        leader, best, pairs = T.lead(m, T.heads(m, _axes(shared, key[0], m.shape[1])), limit, limit / 16)
        if compared is not None:
            compared.add(pairs)
        place, own = pdf["place"].to_numpy(), leader == np.arange(len(m))
        near = np.where(best != T.NONE, place[np.where(best != T.NONE, best & 0xFFFFFFFF, 0)], -1)
        radius = np.zeros(len(m))
        np.maximum.at(radius, leader[~own], T.chord_of(best[~own] >> 32))
        return pd.DataFrame({"grp": key[0], "place": place, "leader": place[leader], "near": near, "steps": best >> 32, "radius": radius, "vector": pdf["vector"].where(own, None)})

    kinds = "grp string, place bigint, leader bigint, near bigint, steps bigint, radius double, vector binary"
    led_rows = checkpointed(cut.select("grp", "cell", "part", "place", "vector").groupBy("grp", "cell", "part").applyInPandas(led, kinds))
    leaders = led_rows.filter("place = leader").select("grp", "place", "near", "radius", "vector")
    told = led_rows.filter("near >= 0").select("grp", "place", "near", "steps")
    found = checkpointed(_tiles(leaders, limit, shared, compared, tile_rows))
    hits = found.filter("sure").groupBy("grp", "place").agg(F.min(F.struct("steps", "near")).alias("best")).select("grp", "place", "best.near", "best.steps")
    # what is left is near no earlier leader, so these rows are far from each other and few of them are around one leader
    perhaps = checkpointed(found.filter("NOT sure").select("grp", "place", F.col("near").alias("leader")).join(hits, ["grp", "place"], "left_anti"))
    if perhaps.isEmpty():
        return _as_distance(told.unionByName(hits))
    followers = led_rows.filter("place <> leader").select("grp", F.col("place").alias("near"), "leader")
    pairs = perhaps.join(followers, ["grp", "leader"]).filter("near < place").select("place", "near")
    pairs = pairs.join(rows.select("grp", "place", "vector"), "place").join(rows.select(F.col("place").alias("near"), F.col("vector").alias("other")), "near")

    def near_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = T.steps(_matrix(batch["vector"]), _matrix(batch["other"]))
                if compared is not None:
                    compared.add(len(d))
                yield batch.assign(steps=d).loc[d <= round(limit * T.STEPS), ["grp", "place", "near", "steps"]]

    more = checkpointed(pairs.select("grp", "place", "near", "vector", "other").mapInPandas(near_ones, "grp string, place bigint, near bigint, steps bigint"))
    more = more.groupBy("grp", "place").agg(F.min(F.struct("steps", "near")).alias("best")).select("grp", "place", "best.near", "best.steps")
    return _as_distance(told.unionByName(hits).unionByName(more))


def _axes(shared, grp: str, n: int) -> np.ndarray:
    return shared.value[grp][1] if grp in shared.value else np.eye(n)


def _as_distance(found: DataFrame) -> DataFrame:
    return found.select("grp", "place", "near", (F.col("steps") / T.STEPS).alias("distance"))


def _tiles(leaders: DataFrame, limit: float, shared, compared: Accumulator | None, tile_rows: int) -> DataFrame:
    """(grp, place, near, steps, sure): of the leaders (grp, place, near, radius, vector) without a ``near`` one, the nearest earlier
    leader within the limit in each tile, or those (not ``sure``) one of whose followers can be within it."""
    spark = leaders.sparkSession
    sizes = leaders.groupBy("grp").count()
    most = -(-(sizes.agg(F.max("count")).first()[0] or 1) // tile_rows)
    cuts = {}
    if most > 1:
        large = leaders.join(F.broadcast(sizes.filter(F.col("count") > tile_rows)), "grp", "left_semi")
        at = large.groupBy("grp").agg(F.percentile_approx("place", [k / most for k in range(1, most)], 100 * most).alias("at"))
        cuts = {g: np.unique(np.array(found)) for g, found in at.collect()}
    cut = spark.sparkContext.broadcast(cuts)

    def packets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, part in batch.groupby("grp"):
                at = cut.value.get(g, np.empty(0, np.int64))
                tile = np.searchsorted(at, part["place"].to_numpy(), side="right")
                for side, some in ((0, np.ones(len(part), bool)), (1, (part["near"] < 0).to_numpy())):
                    rows = []
                    for t in np.unique(tile[some]):
                        few = part[some & (tile == t)]
                        rows.append((g, side, int(t), len(at) if side == 0 else 0, few["place"].to_numpy().tobytes(), few["radius"].to_numpy().tobytes(), b"".join(few["vector"])))
                    yield pd.DataFrame(rows, columns=["grp", "side", "tile", "last", "place", "radius", "vector"])

    sent = checkpointed(leaders.mapInPandas(packets, "grp string, side int, tile int, last int, place binary, radius binary, vector binary"))
    # an earlier leader is in the same tile or one before it
    other = F.when(F.col("side") == 0, F.sequence("tile", "last")).otherwise(F.sequence(F.lit(0), "tile"))
    both = sent.withColumn("other", F.explode(other)).select(
        "grp", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("tile")).alias("asks"), F.when(F.col("side") == 0, F.col("tile")).otherwise(F.col("other")).alias("items"), "side", "place", "radius", "vector"
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(TILE_TASKS, sum((len(at) + 1) * (len(at) + 2) // 2 for at in cuts.values())))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asks, items = (Packet.of(pdf[pdf["side"] == side]) for side in (1, 0))
        empty = pd.DataFrame({"grp": pd.Series(dtype=str), "place": pd.Series(dtype=np.int64), "near": pd.Series(dtype=np.int64), "steps": pd.Series(dtype=np.int64), "sure": pd.Series(dtype=bool)})
        if not len(asks.place) or not len(items.place):
            return empty
        axes, far, pairs = _axes(shared, key[0], asks.rows.shape[1]), round(limit * T.STEPS), 0
        best, who, whom = np.full(len(asks.place), T.NONE), [], []
        for i, j, d in T.compared(asks.rows, items.rows, T.heads(asks.rows, axes), T.heads(items.rows, axes), T.least_of(limit, items.radius)):
            pairs += len(d)
            before = items.place[j] < asks.place[i]
            i, j, d = i[before], j[before], d[before]
            np.minimum.at(best, i[d <= far], (d[d <= far] << 32) | j[d <= far])
            # beyond the limit, but a follower of the leader can be within it
            wide = (d > far) & (T.chord_of(d - 2) <= np.sqrt(2.0 * limit) + items.radius[j] + 1e-5) & (items.radius[j] > 0) & (best[i] == T.NONE)
            who.append(i[wide])
            whom.append(j[wide])
        if compared is not None:
            compared.add(pairs)
        hit = np.flatnonzero(best != T.NONE)
        who, whom = np.concatenate([*who, hit[:0]]), np.concatenate([*whom, hit[:0]])
        who, whom = who[best[who] == T.NONE], whom[best[who] == T.NONE]
        return pd.DataFrame(
            {
                "grp": key[0],
                "place": asks.place[np.concatenate([hit, who])],
                "near": items.place[np.concatenate([best[hit] & 0xFFFFFFFF, whom])],
                "steps": np.concatenate([best[hit] >> 32, np.full(len(who), -1)]),
                "sure": np.concatenate([np.ones(len(hit), bool), np.zeros(len(who), bool)]),
            }
        )

    return both.repartition(tasks, "grp", "asks", "items").groupBy("grp", "asks", "items").applyInPandas(run, "grp string, place bigint, near bigint, steps bigint, sure boolean")


class Packet(NamedTuple):
    """Rows that travel as one: their places, radii and vectors."""

    place: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(pdf: pd.DataFrame) -> Packet:
        place, radius = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("place", np.int64), ("radius", np.float64)))
        return Packet(place, radius, np.frombuffer(b"".join(pdf["vector"]), np.float64).reshape(len(place), -1 if len(place) else 0))
