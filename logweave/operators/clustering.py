"""Building, assigning and improving cluster prototypes."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.functions import rules as R
from logweave.operators import tiles as T
from logweave.operators.knn import DIGITS, _matrix, _unit_rows, in_order, nearest, packed, with_earlier_near
from logweave.operators.upsert import upsert_latest
from logweave.session import checkpointed

DISTANCE_THRESHOLD = 0.2
MIN_SIZE = 5
ONLINE_THRESHOLD = 0.25
EXEMPLARS = 5
#: Undecided texts of an OS that are settled in one task; no result depends on it.
ROUND_ROWS = 5_000


def seeds_in_order(items: DataFrame, threshold: float, round_rows: int = ROUND_ROWS, **knn) -> DataFrame:
    """Seeds (os, id, at, embedding) of items with those columns: in the order of (at, id) within an OS a
    row with no earlier seed within the threshold becomes one.

    Among the rows that are near each other these are the first independent set in that order, which rounds of
    local decisions find: an undecided row without an earlier undecided one near it is a seed, whatever
    happens elsewhere, and the rows near a new seed are out. Rounds grow with the longest chain of rows that wait for
    each other, about the logarithm of the rows where near rows do not follow each other in time. No pairs are kept: both steps
    ask one thing of a cell index. Once no OS has more than ``round_rows`` undecided rows, they are settled in order in
    one bounded task each; no result depends on it.
    """
    rows = in_order(items)
    seeds, _ = _seeds_and_near(rows, threshold, round_rows, **knn)
    return rows.join(seeds.select("place"), "place", "left_semi").select("os", "id", "at", "embedding")


def _seeds_and_near(rows: DataFrame, threshold: float, round_rows: int, **knn) -> tuple[DataFrame, DataFrame]:
    """Seeds (os, place, embedding) of rows of ``in_order``, and for rows that are out the distance of a seed that is near: (place, seed, distance)."""
    # of equal vectors only the first can be a seed
    same = rows.groupBy(F.xxhash64("os", "embedding").alias("hash")).agg(F.count("*").alias("n"), F.min("place").alias("place"))
    twice = checkpointed(rows.withColumn("hash", F.xxhash64("os", "embedding")).join(same.filter("n > 1").select("hash"), "hash", "left_semi").drop("hash"))
    later = twice.select("place").join(twice.groupBy("os", "embedding").agg(F.min("place").alias("place")).select("place"), "place", "left_anti")
    undecided = checkpointed(rows.select("os", "place", "embedding").join(checkpointed(later), "place", "left_anti"))
    seeds, near = undecided.limit(0), undecided.sparkSession.createDataFrame([], "place bigint, seed bigint, distance double")
    while True:
        most = undecided.groupBy("os").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if most <= round_rows:
            return seeds.unionByName(_first_seeds(undecided, threshold)) if most else seeds, near
        waiting = checkpointed(with_earlier_near(undecided.withColumn("id", F.col("place")), threshold, **knn).select(F.col("id").alias("place"), "near", "distance"))
        new = checkpointed(undecided.select("place").join(waiting, "place", "left_anti"))
        # most rows that wait for a row that has become a seed are out with it
        told = checkpointed(waiting.join(new.select(F.col("place").alias("near")), "near", "left_semi").select("place", F.col("near").alias("seed"), "distance"))
        state = new.withColumn("new", F.lit(True)).unionByName(waiting.select("place").join(told, "place", "left_anti").withColumn("new", F.lit(False)))
        marked = checkpointed(undecided.join(state, "place"))
        new, rest = marked.filter("new").drop("new"), marked.filter("NOT new").drop("new")
        seeds = seeds.unionByName(new)
        close = nearest(rest, new.select("os", F.col("place").alias("seed"), "embedding"), 1, "place", "seed", limit=threshold, **knn)
        close = checkpointed(close.select("place", "seed", "distance"))
        near = near.unionByName(told).unionByName(close)
        undecided = checkpointed(rest.join(close.select("place"), "place", "left_anti").select("os", "place", "embedding"))


def single_pass_cluster(
    items: DataFrame, threshold: float = DISTANCE_THRESHOLD, min_size: int = MIN_SIZE, round_rows: int = ROUND_ROWS, **knn
) -> DataFrame:
    """Leader clustering by cosine distance within each OS: (os, id, cluster).

    ``items`` has os, id and embedding. In the order of the ids (numbers as numbers) a row with no
    earlier seed within ``threshold`` opens a cluster; then every row joins its nearest seed, ties to
    the lowest id. ``cluster`` is the id of the seed as text. Clusters below ``min_size`` are left out.

    The rule is the same for any number of rows. A pass with moving centroids would compare rows with
    the mean of the members so far; seeds do not move, and the centroid of a cluster is the unit mean of
    its members only once they are known.
    """
    rows = in_order(items.select("os", F.col("id").cast("string").alias("id"), F.col("id").alias("at"), "embedding"))
    seeds, near = _seeds_and_near(rows, threshold, round_rows, **knn)
    seeds = checkpointed(seeds.select("os", "place", "embedding"))
    # Seeds are farther from each other than the threshold. A row within a quarter of it of a seed is, by the triangle
    # inequality, farther from every other one; the margins are those of rounding.
    sure = near.filter(F.col("distance") + 3e-6 <= (threshold - 1e-6) / 4)
    own = seeds.filter(_solid(seeds)).select("place", F.col("place").alias("seed"), F.lit(0.0).alias("distance"))
    sure = checkpointed(sure.unionByName(own) if threshold > 2e-5 else sure.limit(0))
    names = rows.select("place", "id")
    open_ = rows.join(checkpointed(names.join(sure, "place", "left_anti").select("place")), "place", "left_semi").select("os", F.col("place").alias("row"), "embedding")
    # every row has a seed within the threshold
    clusters = seeds.join(names.withColumnRenamed("id", "cluster"), "place")
    found = nearest(open_, clusters.select("os", "cluster", "embedding"), 1, "row", "cluster", limit=threshold, **knn)
    told = sure.withColumnRenamed("place", "row").join(clusters.select("os", F.col("place").alias("seed"), "cluster"), "seed")
    members = found.select("os", "row", "cluster", "distance").unionByName(told.select("os", "row", "cluster", "distance"))
    # of rows with one id the nearest counts
    members = members.join(names.withColumnRenamed("place", "row"), "row").groupBy("os", "id").agg(F.min(F.struct("distance", "cluster")).alias("best"))
    members = checkpointed(members.select("os", "id", "best.cluster"))
    sizes = members.groupBy("os", "cluster").count().filter(F.col("count") >= max(1, min_size))
    return members.join(sizes.drop("count"), ["os", "cluster"]).select("os", "id", "cluster")


def _solid(rows: DataFrame) -> Column:
    """Whether a packed vector has a length; a zero vector is at distance 1 even from itself."""
    return F.ltrim(F.hex("embedding"), F.lit("0")) != ""


def centroids(members: DataFrame, keys: Sequence[str] = ("os", "cluster")) -> DataFrame:
    """Unit mean of the unit member vectors: (keys, centroid). ``embedding`` is the vector, packed or not."""
    keys = list(keys)
    rows = packed(members.filter("embedding IS NOT NULL").select(*keys, F.col("embedding").alias("total")), "total").withColumn("n", F.lit(1).cast("bigint"))
    schema = rows.schema

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        code = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        totals = np.add.reduceat(_matrix(rows["total"])[order], starts, axis=0)
        return rows[keys].iloc[order[starts]].assign(total=[t.tobytes() for t in totals], n=np.add.reduceat(rows["n"].to_numpy()[order], starts))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from (added(batch) for batch in batches if len(batch))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if len(batch):
                batch = added(batch if last is None else pd.concat([last, batch]))
                last = batch.iloc[-1:]  # its cluster may go on
                if len(batch) > 1:
                    yield mean(batch.iloc[:-1])
        if last is not None:
            yield mean(last)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        centers = _unit_rows(_matrix(rows["total"]) / rows["n"].to_numpy()[:, None])
        return rows[keys].assign(centroid=list(centers))

    # of a large cluster each batch sends one row
    sums = rows.mapInPandas(partial, schema).repartition(*keys).sortWithinPartitions(*keys)
    out = ", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(whole, f"{out}, centroid array<double>")


def medoids(members: DataFrame, centers: DataFrame, keys: Sequence[str] = ("os", "cluster")) -> DataFrame:
    """Member nearest to its centroid, ties to the lowest id: (keys, medoid_id, distance)."""
    keys = list(keys)
    rows = packed(members.filter("embedding IS NOT NULL").select(*keys, "id", "embedding"), "embedding")
    joined = rows.join(packed(centers.select(*keys, "centroid"), "centroid"), keys)
    out = ", ".join(f"`{k}` {joined.schema[k].dataType.simpleString()}" for k in [*keys, "id"])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[[*keys, "id"]].assign(_d=T.steps(_matrix(batch["embedding"]), _matrix(batch["centroid"])) / T.STEPS)

    best = joined.mapInPandas(measured, f"{out}, _d double").groupBy(*keys).agg(F.min(F.struct("_d", "id")).alias("_best"))
    return best.select(*keys, F.col("_best.id").alias("medoid_id"), F.col("_best._d").alias("distance"))


def label_clusters(
    documents: DataFrame, keys: Sequence[str] = ("os", "cluster"), order: str = "id"
) -> DataFrame:
    """Majority failure label of the member documents; a tie goes to the label seen first."""
    label = F.get(R.failure_labels(F.col("document")), F.lit(0))
    votes = documents.select(*keys, F.col(order).alias("_at"), label.alias("_label"))
    counted = votes.groupBy(*keys, "_label").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # least (-votes, first seen) among labels; the null label only keeps signal-free clusters alive
    best = counted.groupBy(*keys).agg(
        F.min(F.when(F.col("_label").isNotNull(), F.struct(-F.col("_n"), "_first", "_label"))).alias("_best")
    )
    return best.select(
        *keys,
        F.coalesce(F.col("_best._label"), F.lit("unknown")).alias("label"),
        F.when(F.col("_best").isNotNull(), "keyword_rules").otherwise("no_signal").alias("rationale"),
    )


def build_prototypes(members: DataFrame, run_id: str = "") -> DataFrame:
    """One prototype per cluster from member rows (os, cluster, id, document, embedding); vectors may be packed.

    Ids are ``cluster_<first member>``, with a run id in front where runs must not overwrite
    each other.
    """
    keys = ["os", "cluster"]
    centers = centroids(members)
    middle = medoids(members, centers).select(
        *keys, F.col("medoid_id").alias("id")
    ).join(members.select(*keys, "id", F.col("document").alias("medoid_document")), [*keys, "id"]).drop("id")
    w = Window.partitionBy(*keys).orderBy("id")
    first = members.select(*keys, "id").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= EXEMPLARS)
    exemplars = first.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("exemplar_ids"))
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    parts = [centers, label_clusters(members), sizes, middle, exemplars]
    joined = functools.reduce(lambda a, b: a.join(b, keys), parts)
    prefix = f"cluster_{run_id}_" if run_id else "cluster_"
    return joined.select(
        "os",
        F.concat(F.lit(prefix), F.col("cluster")).alias("cluster_id"),
        "centroid",
        "label",
        "rationale",
        F.col("size").cast("int").alias("size"),
        "medoid_document",
        "exemplar_ids",
        F.lit(None).cast("string").alias("solution"),
    )


def cluster_input(templates: DataFrame, logs: DataFrame) -> DataFrame:
    """Template vectors plus the vectors of all distinct log texts of each OS, under the lowest id."""
    cols = ["os", "id", "document", "embedding"]
    texts = logs.groupBy("os", "document").agg(F.min("id").alias("id"), F.any_value("embedding").alias("embedding"))
    return templates.select(*cols).unionByName(texts.select(*cols))


def cluster_templates(
    items: DataFrame, threshold: float = DISTANCE_THRESHOLD, min_size: int = MIN_SIZE, run_id: str = "", **knn: int
) -> DataFrame:
    """Prototypes of all OSes from rows (os, id, document, embedding)."""
    found = single_pass_cluster(items, threshold, min_size, **knn)
    # read several times below
    members = items.withColumn("id", F.col("id").cast("string")).join(found, ["os", "id"]).filter("embedding IS NOT NULL")
    members = checkpointed(packed(members.select("os", "cluster", "id", "document", "embedding"), "embedding"))
    return build_prototypes(members, run_id)


def cluster_report(prototypes: DataFrame) -> DataFrame:
    """Clusters and prototypes per OS."""
    n = F.count(F.lit(1))
    return prototypes.groupBy("os").agg(n.alias("clusters"), n.alias("prototypes"))


def text_id(os: Column, templated: Column) -> Column:
    """Key of a masked line within its OS; long enough that two texts never share one."""
    return F.sha1(F.concat_ws("|", os, templated))


def online_id(os: Column, templated: Column) -> Column:
    """Id of a prototype seeded by a line; the same line always gives the same id."""
    return F.concat(F.lit("cluster_"), text_id(os, templated))


def assign_clusters(
    logs: DataFrame,
    prototypes: DataFrame,
    threshold: float = ONLINE_THRESHOLD,
    round_rows: int = ROUND_ROWS,
    **knn,
) -> tuple[DataFrame, DataFrame]:
    """Cluster id per distinct (os, templated), and the prototypes that had to be created.

    ``logs`` has os, templated, log_id and embedding. A text goes to the nearest prototype within
    the threshold. The others are taken in order of first appearance: a text with no earlier seed
    within the threshold becomes one itself, and every other one takes its nearest seed.
    """
    texts = logs.groupBy("os", "templated").agg(
        F.min("log_id").alias("first_log"), F.any_value("embedding").alias("embedding")
    ).withColumn("text_id", online_id(F.col("os"), F.col("templated")))
    texts = checkpointed(texts)
    near = nearest(
        texts, prototypes.select("os", "cluster_id", F.col("centroid").alias("embedding")), 1, "text_id", "cluster_id", limit=threshold, **knn
    )
    near = checkpointed(near.select("text_id", "cluster_id", "distance"))
    open_texts = checkpointed(texts.join(near, "text_id", "left_anti"))
    rows = open_texts.select("os", F.col("text_id").alias("id"), F.col("first_log").alias("at"), "embedding")
    found = seeds_in_order(rows, threshold, round_rows, **knn).select(F.col("id").alias("text_id"))
    seeds = checkpointed(open_texts.join(found, "text_id", "left_semi"))
    # the nearest seed for every open text, seeds included (distance 0 to themselves)
    own = nearest(
        open_texts.select("os", "text_id", "embedding"),
        seeds.select("os", F.col("text_id").alias("cluster_id"), "embedding"), 1, "text_id", "cluster_id", limit=threshold, **knn
    ).select("text_id", "cluster_id", "distance")
    chosen = near.unionByName(own)
    assigned = texts.join(chosen, "text_id").select("os", "templated", "cluster_id", "distance")
    created = seeds.select(
        "os",
        F.col("text_id").alias("cluster_id"),
        F.col("embedding").alias("centroid"),
        F.lit("unknown").alias("label"),
        F.lit("online").alias("rationale"),
        F.lit(1).alias("size"),
        F.col("templated").alias("medoid_document"),
        F.array().cast("array<string>").alias("exemplar_ids"),
        F.lit(None).cast("string").alias("solution"),
    )
    return assigned, created


def _first_seeds(head: DataFrame, threshold: float) -> DataFrame:
    """Seeds among one bounded block of rows per OS, in order."""
    cols = ["os", "place", "embedding"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        m = _matrix(pdf["embedding"])
        free = np.ones(len(m), dtype=bool)
        rows: list[int] = []
        for at in range(len(m)):
            if free[at]:  # one product for each seed, not for each row
                rows.append(at)
                d = np.round(1.0 - np.clip(m[at:] @ m[at], -1.0, 1.0), DIGITS)
                free[at:] &= d > threshold
        return pdf.iloc[rows][cols]

    bounded = head.select(*cols)
    return bounded.groupBy("os").applyInPandas(run, bounded.schema)


def relabel_prototypes(prototypes: DataFrame, results: DataFrame) -> DataFrame:
    """Prototypes with the label and solution learned from cluster results.

    ``results`` has os, cluster_id, ts, failure_type and recommendation; the latest one counts.
    """
    latest = results.groupBy("os", "cluster_id").agg(
        F.max_by(F.struct("failure_type", "recommendation"), "ts").alias("_r")
    )
    known = F.col("_r").isNotNull()
    learned = F.nullif(F.col("_r.recommendation"), F.lit(""))
    return prototypes.join(latest, ["os", "cluster_id"], "left").withColumns(
        {
            "label": F.coalesce(F.col("_r.failure_type"), F.col("label")),
            "rationale": F.when(known, "llm_cluster").otherwise(F.col("rationale")),
            "solution": F.coalesce(learned, F.col("solution")),
        }
    ).drop("_r")


def logs_with_cluster(logs: DataFrame, assigned: DataFrame) -> DataFrame:
    """Logs with the cluster of their (os, templated) text."""
    return logs.join(assigned.select("os", "templated", "cluster_id"), ["os", "templated"], "left")


def improve_prototypes(
    prototypes: DataFrame,
    feedback_logs: DataFrame,
    run_id: str,
    threshold: float = DISTANCE_THRESHOLD,
    min_size: int = max(1, MIN_SIZE // 2),
) -> DataFrame:
    """Prototypes upserted with those learned from the logs of alerts marked correct.

    ``feedback_logs`` has os, id, document and embedding, one row per log.
    """
    learned = cluster_templates(feedback_logs, threshold, min_size, run_id=run_id)
    both = prototypes.withColumn("_v", F.lit(0)).unionByName(learned.withColumn("_v", F.lit(1)))
    return upsert_latest(both, ["os", "cluster_id"], "_v").drop("_v")
