"""Exact top-k search by inner product, term at a time.

The vectors are sparse rows of integer weights; a term is a position. A task holds one block of candidates
as postings (slots and weights of each term) and lets one block of queries pass: every weight of a query is
scattered, times the weights of its term's postings, into a dense array of scores, of which a partition
selection leaves k; the selections of all blocks are merged. Every candidate is scored, none is pruned.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logweave.session import checkpointed, spread

#: Components of a block of candidates (about 100 MB as postings), queries of a block, cells of score arrays.
CANDIDATE_TERMS, QUERY_ROWS, SCORES = 1 << 23, 1 << 16, 1 << 20


def quantized(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, weights): floor(scale * x) of every component, as double; rows that are null or hold a
    null or non-finite component are left out. Values beyond 64 bits stop at their bounds."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.filter(usable).select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("weights"))


class Postings:
    """Slots and weights of every term over a block of candidates, which come in ascending order of id."""

    def __init__(self, ids: pa.Array, rows: np.ndarray, flat: np.ndarray, lengths: np.ndarray):
        self.ids, self.rows, self.n = ids, rows, len(rows)
        first = np.cumsum(lengths) - lengths
        slot = np.repeat(np.arange(self.n), lengths)
        term = np.arange(len(flat)) - np.repeat(first, lengths)
        some = flat != 0
        slot, term, flat = slot[some], term[some], flat[some]
        order = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[order], np.arange(int(lengths.max(initial=0)) + 1))
        slot, flat = slot[order], flat[order]
        # a term that every candidate has needs no slots
        self.terms = [(None if b - a == self.n else slot[a:b], flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(queries), self.n), np.int64)
        for line, query in zip(out, queries, strict=True):
            for term in np.flatnonzero(query[: len(self.terms)]):
                slots, weights = self.terms[term]
                if slots is None:
                    line += query[term] * weights
                else:
                    line[slots] += query[term] * weights
        return out

    def best(self, line: np.ndarray, own: int, k: int) -> np.ndarray:
        """Slots of the k highest scores without the row ``own``; ties go to the smaller slot."""
        size = min(k + 1, self.n)
        bound = np.partition(line, self.n - size)[self.n - size]
        above, equal = np.flatnonzero(line > bound), np.flatnonzero(line == bound)
        chosen = np.concatenate([above, equal[: size - len(above)]])
        chosen = chosen[np.lexsort((chosen, ~line[chosen]))]
        return chosen[self.rows[chosen] != own][:k]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _search(k: int):
    """Rows (cell, side, row, vec_id, weights), sorted by the first two and vec_id: candidates before queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, postings = None, [], None
        for batch in batches:
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, held, postings = cells[a], [], None
                flat, lengths = _lists(part.column(4))
                if sides[a] == 0:
                    held.append((part.column(3), part.column(2).to_numpy(), flat.copy(), lengths))
                    continue
                if not held and postings is None:
                    continue
                if postings is None:
                    ids, rows, weights, sizes = zip(*held, strict=True)
                    postings, held = Postings(pa.chunked_array(ids).combine_chunks(), *map(np.concatenate, (rows, weights, sizes))), []
                yield from _answer(postings, part, np.split(flat, np.cumsum(lengths)[:-1]), k)

    return run


def _answer(postings: Postings, part: pa.RecordBatch, queries: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    rows = part.column(2).to_numpy()
    step = max(1, SCORES // postings.n)
    for a in range(0, len(queries), step):
        lines = postings.scores(queries[a : a + step])
        slots = [postings.best(line, own, k) for line, own in zip(lines, rows[a : a + step], strict=True)]
        sizes = list(map(len, slots))
        flat = np.concatenate(slots)
        of = np.repeat(np.arange(len(lines)), sizes)
        yield pa.RecordBatch.from_arrays(
            [part.column(2).slice(a, len(lines)).take(pa.array(of)), part.column(3).slice(a, len(lines)).take(pa.array(of)), postings.ids.take(pa.array(flat)), pa.array(lines[of, flat])],
            names=["row", "query_id", "vec_id", "score"],
        )


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` candidates of the highest inner product for every query.

    ``vectors`` has vec_id and weights (longs, none null). Queries are the rows whose id is divisible by
    ``every``, candidates all rows but the query's own; ties go to the smaller id, rows without an id last.
    Where an id stands on several rows, each is a query and a candidate of its own (its own row is never its
    candidate). Vectors may differ in length: a missing component is zero. Scores are 64-bit sums, which wrap
    around beyond. Fewer candidates than ``k`` give fewer rows, an empty table none.

    Rows are dealt by a number written with them, not by content, so that equal vectors or ids make no block
    larger; a block is bounded by its components, whatever the number of rows.
    """
    spark = vectors.sparkSession
    rows = checkpointed(spread(vectors).select("vec_id", "weights").withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("weights")), F.lit(0)).alias("terms")).first()
    queries = asked.count()
    across = max(-(-size["terms"] // CANDIDATE_TERMS), min(size["n"] // 256, 2 * spark.sparkContext.defaultParallelism), 1)
    down = max(-(-queries // QUERY_ROWS), 1)
    # consecutive numbers of a task go round the blocks, each task beginning at a block of its own
    turn = F.col("row") + F.shiftright("row", 33) * 7919
    held = rows.select(F.pmod(turn, F.lit(across)).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("y"), F.lit(0).alias("side"), "row", "vec_id", "weights")
    passing = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("x"), F.pmod(turn, F.lit(down)).alias("y"), F.lit(1).alias("side"), "row", "vec_id", "weights")
    cells = held.unionByName(passing).select((F.col("x") * down + F.col("y")).alias("cell"), "side", "row", "vec_id", "weights")
    dealt = cells.repartitionById(across * down, F.col("cell").cast("int")).sortWithinPartitions("cell", "side", F.col("vec_id").asc_nulls_last(), "row")
    found = dealt.mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
