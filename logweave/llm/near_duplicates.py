"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Each of HASHES permutations gives two signature values, the
smallest and the largest hash, so that 64 hash evaluations make a signature of 128; bands of it are
the buckets. Documents of one set are one node from the start. In a bucket every node is compared, on
full sets, with one pivot: the node with the most company over all its buckets, which in a group of
copies is the one nearest to the rest. Only nodes of a bucket that are still apart after that are
compared with each other, in blocks of bounded size; a link is a link whoever found it, so no pair of a
group needs to be written out, and none that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logweave.llm.components import connected
from logweave.llm.sketch import drop_absent, drop_present, hash_bitmap
from logweave.llm.stretches import text_slices
from logweave.llm.words import give_back, mix, window_hashes, words_of, worker_state
from logweave.operators.hot_keys import hot_keys, look_up
from logweave.session import checkpointed, inner_tables, kept

#: Permutations; each gives a minimum and a maximum. Values in a band: 32 bands of 4 miss a pair of
#: similarity 0.8 with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
HASHES, BAND = 64, 4
#: Nodes on either side of a block of comparisons.
BLOCK = 512

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_SHIFTS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle."""
    w = words_of(texts, lower=True)
    at, hashes = window_hashes(w, size)
    doc = w.doc[at]
    counts = np.bincount(w.doc, minlength=len(texts))
    for n in range(1, size):
        few = np.flatnonzero(counts == n)
        if len(few):
            a, h = window_hashes(w, n)
            keep = np.isin(w.doc[a], few)
            doc, hashes = np.concatenate([doc, w.doc[a[keep]]]), np.concatenate([hashes, h[keep]])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[fresh], hashes[fresh]
    return np.split(hashes, np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 2 * HASHES): minimum and maximum under each permutation; sets are not empty."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), 2 * HASHES), _U)
    for k in range(HASHES):
        x = (flat ^ _SHIFTS[k]) * _FACTORS[k]  # a permutation of the 64-bit values
        out[:, 2 * k] = np.minimum.reduceat(x, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band of a row, different between bands."""
    n = signature.shape[1] // BAND
    out = np.zeros((len(signature), n), _U)
    for k in range(BAND):
        out = mix(out * _U(0x9E3779B97F4A7C15) + signature[:, k::BAND][:, :n])
    return mix(out + np.arange(n, dtype=_U) * _U(0xD1B54A32D192ED03))


def _identity(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def sketches(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (128-bit hash of the set; null if empty), bands (null if empty)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = source.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_duplicates")
        for batch in batches:
            for rows, part in text_slices(batch, 2):
                sets = shingle_sets(part, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                found: list = [None] * len(part)
                nodes: list = [None] * len(part)
                if full:
                    for i, b in zip(full, bands(signatures([sets[i] for i in full])).view(np.int64), strict=True):
                        found[i], nodes[i] = b, _identity(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )
        give_back()

    return keyed.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>")


def node_sets(docs: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one document each: wanted has doc_id and text_hash.

    Wanted documents are told by a bitmap, so that no text is shuffled. It lets a few others pass; whoever joins with the nodes leaves them out.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = lambda text_hash: F.xxhash64(F.col("doc_id").isNull(), "doc_id", text_hash)
    keys = checkpointed(wanted.select(place(F.col("text_hash")).alias("key")))
    chosen = drop_absent(source, place(F.xxhash64("text")), hash_bitmap(keys)).select("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("near_duplicates")
        for batch in batches:
            for _, part in text_slices(batch, 0):
                sets = shingle_sets(part, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_identity(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"]
                )
        give_back()

    return chosen.mapInArrow(run, "node binary, shingles array<long>")


def _linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def pivot_links(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pivots (bucket, pivot), links (a, b)) of members (bucket, node, others)."""
    company = members.groupBy("node").agg(F.sum("others").alias("company"))
    pivots = checkpointed(
        members.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("best")).select("bucket", F.col("best.node").alias("pivot"))
    )
    pairs = checkpointed(members.join(pivots, "bucket").filter("node <> pivot").select("node", "pivot").distinct())
    left = pairs.join(sets, "node")
    right = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    n, m = F.size("shingles"), F.size("pivot_shingles")
    common = F.size(F.array_intersect("shingles", "pivot_shingles"))
    possible = _linked(F.least(n, m), n, m, percent)
    # the centre of a very large group meets its nodes in parts
    met = look_up(left, right, ["pivot"], F.col("node"), hot_keys(pairs, ["pivot"]))
    found = met.filter(possible).filter(_linked(common, n, m, percent))
    return pivots, checkpointed(found.select(F.col("node").alias("a"), F.col("pivot").alias("b")))


def _compare(percent: int):
    """Links between the two sides of each block: rows (bucket, i, j, side, node, root, shingles)."""

    def run(rows):
        import pandas as pd

        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        found = []
        if len(a) and len(b):
            sizes_a = np.array([len(s) for s in a["shingles"]])
            sizes_b = np.array([len(s) for s in b["shingles"]])
            values, place = np.unique(np.concatenate([*a["shingles"], *b["shingles"]]), return_inverse=True)
            cut = sizes_a.sum()
            common = np.zeros((len(a), len(b)), np.float32)
            at_a, at_b = np.repeat(np.arange(len(a)), sizes_a), np.repeat(np.arange(len(b)), sizes_b)
            for low in range(0, len(values), 4096):  # a stretch of shingles at a time bounds the matrices
                x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
                for matrix, at, column in ((x, at_a, place[:cut]), (y, at_b, place[cut:])):
                    inside = (column >= low) & (column < low + 4096)
                    matrix[at[inside], column[inside] - low] = 1
                common += x @ y.T
            apart = a["root"].to_numpy()[:, None] != b["root"].to_numpy()[None, :]
            total = sizes_a[:, None] + sizes_b[None, :] - common
            hit = (100 * common >= percent * total) & apart
            # one link for each pair of components is enough
            seen = set()
            for i, j in zip(*np.nonzero(hit), strict=True):
                roots = frozenset((a["root"].iat[i], b["root"].iat[j]))
                if roots not in seen:
                    seen.add(roots)
                    found.append((a["node"].iat[i], b["node"].iat[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def rest_links(members: DataFrame, pivots: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of a bucket that are in different components and of which none is the pivot.

    The nodes outside the pivot's component are compared with all others of their bucket, in blocks of
    BLOCK by BLOCK; buckets whose other nodes are one component are done.
    """
    placed = members.join(roots, "node").join(pivots, "bucket")
    home = placed.filter("node = pivot").select("bucket", F.col("root").alias("home"))
    others = placed.filter("node <> pivot").join(home, "bucket")
    open_buckets = others.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.count(F.when(F.col("root") != F.col("home"), 1)).alias("away")).filter("low <> high")
    cells = checkpointed(
        others.join(open_buckets.select("bucket", "n", "away"), "bucket").select(
            "bucket", "node", "root", (F.col("root") != F.col("home")).alias("out"),
            F.ceil(F.col("n") / BLOCK).cast("int").alias("columns"), F.ceil(F.col("away") / BLOCK).cast("int").alias("lines"),
        )
    )
    if cells.limit(1).count() == 0:
        return members.sparkSession.createDataFrame([], "a binary, b binary")
    chance = F.xxhash64("node")
    side = [
        cells.filter("out").select("bucket", "node", "root", F.lit(0).alias("side"), F.pmod(chance, F.col("lines")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j")),
        cells.select("bucket", "node", "root", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lines") - 1)).alias("i"), F.pmod(chance, F.col("columns")).alias("j")),
    ]
    rows = side[0].select("bucket", "i", "j", "side", "node", "root").unionByName(side[1].select("bucket", F.col("i").cast("long").alias("i"), "j", "side", "node", "root"))
    return checkpointed(rows.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(_compare(percent), "a binary, b binary"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """For every row: doc_id, text_hash, n_shingles, component_id, first, kept.

    Words are runs of non-blanks, A-Z lower-cased. A text of fewer than ``shingle`` words is one shingle;
    a null text or one without words is an empty set, linked with nothing. Documents are linked if
    100 * common >= percent * united shingles. ``component_id`` is the smallest id reachable (null ids
    are passed over), ``kept`` marks the rows with that id; a row without id is kept if all of its
    component are. ``first`` marks the one text that stands for the component. Repeated rows are judged alike; an empty table gives no rows.
    """
    with inner_tables(docs.sparkSession):
        sketch = kept(sketches(docs, shingle, doc_id, text))
        nodes = checkpointed(
            sketch.filter("node is not null").groupBy("node").agg(
                F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("of"), F.first("bands").alias("bands")
            )
        )
        placed = nodes.select("node", F.explode("bands").alias("bucket"))
        shared = placed.groupBy("bucket").agg(F.count("*").alias("others")).filter("others > 1")
        members = checkpointed(placed.join(shared, "bucket"))
        present = checkpointed(members.select("node").distinct())
        with inner_tables(docs.sparkSession):
            sets = checkpointed(node_sets(docs, present.join(nodes, "node").select("of.doc_id", "of.text_hash"), shingle, doc_id, text).dropDuplicates(["node"]))
            pivots, links = pivot_links(members, sets, percent)
            roots = connected(present, links)
            more = rest_links(members, pivots, roots, sets, percent)
            if more.limit(1).count():
                # components so far are the nodes of the second round
                label = lambda c, to: more.select("a", "b").join(roots.select(F.col("node").alias(c), F.col("root").alias(to)), c)
                lifted = label("a", "ra").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
                tops = connected(roots.select(F.col("root").alias("node")).distinct(), lifted).select(F.col("node").alias("root"), F.col("root").alias("top"))
                roots = look_up(roots, tops, ["root"], F.col("node"), hot_keys(roots, ["root"])).select("node", F.col("top").alias("root"))
            roots = kept(roots)
        least = nodes.join(roots, "node").groupBy("root").agg(F.min("least_id").alias("linked_id"), F.min("of").alias("linked_of"))
        linked = look_up(roots, least, ["root"], F.col("node"), hot_keys(roots, ["root"])).select("node", "linked_id", "linked_of")
        component = kept(nodes.join(linked, "node", "left").select("node", F.coalesce("linked_id", "least_id").alias("component_id"), F.coalesce("linked_of", "of").alias("of")))
    own = sketch.filter("node is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    first = F.col("doc_id").eqNullSafe(F.col("of.doc_id")) & (F.col("text_hash") == F.col("of.text_hash"))
    whole = sketch.filter("node is not null").drop("bands")
    found = look_up(whole, component, ["node"], F.struct("doc_id", "text_hash"), hot_keys(sketch, ["node"])).select("doc_id", "text_hash", "n_shingles", "component_id", first.alias("first"))
    return found.unionByName(own).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns as they are: the first by id (nulls last), then text hash;
    of rows that agree in both one stays."""
    key = {"_near_id": F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), "_near_hash": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))}
    names = [F.col(f"`{c}`") for c in docs.columns]
    with inner_tables(docs.sparkSession):
        judged = checkpointed(near_duplicates(docs, doc_id, text, shingle, percent).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_near_id"), F.col("text_hash").alias("_near_hash"), "first"))
        # rows to drop, and rows that agree in both: only texts that some such row has are shuffled
        rest = kept(judged.groupBy("_near_id", "_near_hash").agg(F.count("*").alias("n"), F.max("first").alias("first")).filter("n > 1 or not first"))
    found = hash_bitmap(rest.select(F.col("_near_hash").alias("key")))
    keyed = docs.withColumns(key)
    # an outer join: Spark would run an anti join before the bitmap, with all texts
    dropped = rest.filter("not first").select("_near_id", "_near_hash", F.lit(True).alias("_near_out"))
    met = drop_absent(keyed, F.col("_near_hash"), found).join(dropped, ["_near_id", "_near_hash"], "left").filter("_near_out is null")
    return drop_present(keyed, F.col("_near_hash"), found).select(*names).unionByName(met.dropDuplicates(["_near_id", "_near_hash"]).select(*names))
