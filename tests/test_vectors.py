"""Neighbours and clustering against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.functions import vectors as V
from logweave.operators import clustering as C, embedding as B, enrichment as N, knn as K, tiles as T

DIM = 8


def vectors(n, seed=1, groups=("linux", "macos")):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, DIM))
    return [(i, groups[0] if i % 3 else groups[-1], m[i].tolist()) for i in range(n)]


def frame(spark, rows, id_name):
    return spark.createDataFrame(rows, f"{id_name} long, os string, embedding array<double>")


def unit(v):
    v = np.array(v)
    return v / (np.linalg.norm(v) or 1.0)


def brute(queries, items, k):
    out = {}
    for q, g, v in queries:
        d = sorted((round(float(1 - np.clip(unit(v) @ unit(w), -1, 1)), 6), i) for i, h, w in items if h == g)
        out[q] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("bytes_,block", [(10**6, 50), (0, 7), (0, 1000)])
def test_nearest_is_exact_either_way(spark, bytes_, block):
    items = vectors(60, 2)
    # equal vectors tie and go by id; a zero vector is at distance 1 from everything
    items += [(100, "linux", items[1][2]), (101, "linux", [0.0] * DIM)]
    queries = vectors(80, 5) + [(900, "linux", [0.0] * DIM), (901, "nowhere", [1.0] * DIM)]
    found = K.nearest(frame(spark, queries, "q"), frame(spark, items, "i"), 4, "q", "i", broadcast_bytes=bytes_, block_rows=block)
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.i)
    want = {q: ids for q, ids in brute(queries, items, 4).items() if ids}
    assert got == want


def clustered(n, groups, seed, centers=120, dim=16):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(1).normal(size=(centers, dim))
    rows = middle[rng.integers(0, centers, n)] + 0.05 * rng.normal(size=(n, dim))
    return [(i, groups[i % len(groups)], rows[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("bytes_,block", [(10**9, 500), (0, 400), (0, 10**6)])
def test_few_pairs_are_compared(spark, bytes_, block):
    items = clustered(6000, ("linux",), 3)
    # a third of the items are one vector: their cell is larger than a block
    items = [(i, g, items[0][2] if i % 3 == 0 else v) for i, g, v in items] + [(9000, "macos", items[1][2])]
    queries = clustered(1500, ("linux",), 4) + [(3000 + i, "macos", v) for i, _, v in clustered(20, ("macos",), 5)] + [(4000, "linux", [0.0] * 16)]
    counted = spark.sparkContext.accumulator(0)
    found = K.nearest(frame(spark, queries, "q"), frame(spark, items, "i"), 3, "q", "i", broadcast_bytes=bytes_, block_rows=block, compared=counted).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.q, r.rank)):
        got.setdefault(r.q, []).append(r.i)
    ids, m = np.array([i for i, g, _ in items if g == "linux"]), np.array([unit(v) for _, g, v in items if g == "linux"])
    for q, g, v in queries:
        if g == "linux":
            d = np.round(1 - np.clip(m @ unit(v), -1, 1), 6)
            assert got[q] == ids[np.lexsort((ids, d))[:3]].tolist()
        else:
            assert got[q] == [9000]
    assert counted.value < 0.25 * len(queries) * len(items)
    near = K.nearest(frame(spark, queries, "q"), frame(spark, items, "i"), 3, "q", "i", broadcast_bytes=bytes_, block_rows=block, limit=0.01).collect()
    assert sorted(map(tuple, near)) == sorted(tuple(r) for r in found if r.distance <= 0.01)


@pytest.mark.parametrize("bytes_,block", [(10**9, 500), (0, 60)])
def test_earlier_near_is_exact(spark, bytes_, block):
    rows = [(i, g, v) for i, g, v in clustered(700, ("linux", "macos"), 6, 30)]
    df = frame(spark, rows, "id").withColumn("at", F.col("id") % 50)
    counted = spark.sparkContext.accumulator(0)
    got = {(r.os, r.id) for r in K.with_earlier_near(df, 0.02, broadcast_bytes=bytes_, block_rows=block, compared=counted).collect()}
    want = set()
    for i, g, v in rows:
        before = [w for j, h, w in rows if h == g and (j % 50, j) < (i % 50, i)]
        if before and np.round(1 - np.clip(np.array([unit(w) for w in before]) @ unit(v), -1, 1), 6).min() <= 0.02:
            want.add((g, i))
    assert got == want and 0 < counted.value < 0.5 * len(rows) ** 2


def test_nearest_without_items(spark):
    none = frame(spark, [], "i")
    assert K.nearest(frame(spark, vectors(3), "q"), none, 2, "q", "i").count() == 0


def seed_model(rows, threshold):
    """Clusters of one OS by seed: first the seeds in order, then every row to its nearest one."""
    d = lambda a, b: round(1 - float(np.clip(a @ b, -1, 1)), 6)
    rows = [(i, unit(v)) for i, v in rows]
    seeds = []
    for i, u in rows:
        if all(d(u, s) > threshold for _, s in seeds):
            seeds.append((i, u))
    clusters = {}
    for i, u in rows:
        clusters.setdefault(min((d(u, s), str(k)) for k, s in seeds)[1], set()).add(i)
    return clusters


@pytest.mark.parametrize("threshold,min_size", [(0.2, 1), (0.5, 2), (0.9, 5)])
def test_single_pass_is_the_sequential_pass(spark, threshold, min_size):
    rows = [(i + 95, g, v) for i, g, v in vectors(150, 7)]  # ids of two and three digits: numbers, not text, order them
    got = {}
    for r in C.single_pass_cluster(frame(spark, rows, "id"), threshold, min_size).collect():
        got.setdefault((r.os, r.cluster), set()).add(int(r.id))
    want = {}
    for os in ("linux", "macos"):
        for seed, ids in seed_model([(i, v) for i, g, v in rows if g == os], threshold).items():
            if len(ids) >= min_size:
                want[(os, seed)] = ids
    assert got == want


def blobs(spark):
    rng = np.random.default_rng(4)
    centers = np.eye(DIM)
    rows = [(1000 + i, "linux", (centers[i % DIM] + 0.02 * rng.normal(size=DIM)).tolist()) for i in range(200)]
    return frame(spark, rows, "id")


@pytest.mark.parametrize("round_rows,bytes_", [(0, 10**6), (40, 0)])
def test_clusters_do_not_depend_on_the_round_size(spark, round_rows, bytes_):
    rows = frame(spark, [(i, g, v) for i, g, v in vectors(120, 9)], "id")
    whole = {tuple(r) for r in C.single_pass_cluster(rows, 0.5, 1).collect()}
    cut = C.single_pass_cluster(rows.repartition(7), 0.5, 1, round_rows, broadcast_bytes=bytes_, block_rows=11)
    assert whole == {tuple(r) for r in cut.collect()} and len({c for _, _, c in whole}) > 10


def test_prototypes(spark):
    docs = blobs(spark).withColumn("document", F.when(F.col("id") % DIM == 0, F.concat(F.lit("io error "), "id")).when(F.col("id") % 16 == 1, "link down").when(F.col("id") % 16 == 9, "overheat").otherwise("calm"))
    protos = {r.cluster_id: r for r in C.cluster_templates(docs, run_id="r1").collect()}
    assert len(protos) == DIM and all(p.startswith("cluster_r1_") for p in protos)
    first = protos["cluster_r1_1000"]
    assert (first.size, first.label, first.rationale) == (25, "disk", "keyword_rules")
    assert first.exemplar_ids == ["1000", "1008", "1016", "1024", "1032"]
    assert protos["cluster_r1_1002"].label == "unknown" and protos["cluster_r1_1002"].rationale == "no_signal"
    assert abs(np.linalg.norm(first.centroid) - 1) < 1e-9


def test_label_tie_goes_to_the_first_seen(spark):
    rows = [(1, "calm"), (2, "overheat"), (3, "link down"), (4, "link down"), (5, "overheat")]
    df = spark.createDataFrame([("linux", 1, i, d) for i, d in rows], "os string, cluster int, id int, document string")
    assert C.label_clusters(df).first().label == "thermal"


def seeds_model(rows, known, threshold):
    seeds = []
    for i, v in rows:
        if any(round(float(1 - unit(v) @ unit(w)), 6) <= threshold for _, w in known):
            continue
        if not any(round(float(1 - unit(v) @ unit(w)), 6) <= threshold for _, w in seeds):
            seeds.append((i, v))
    return [i for i, _ in seeds]


@pytest.mark.parametrize("block_rows,bytes_", [(10**6, 10**6), (0, 10**6), (6, 0)])
def test_online_seeds_do_not_depend_on_the_round_size(spark, block_rows, bytes_):
    rows = vectors(60, 9, ("linux", "linux"))
    logs = frame(spark, rows, "log_id").withColumn("templated", F.concat(F.lit("text "), F.col("log_id")))
    known = vectors(3, 11, ("linux", "linux"))
    protos = frame(spark, known, "n").select("os", F.concat(F.lit("p"), F.col("n")).alias("cluster_id"), F.col("embedding").alias("centroid"))
    assigned, created = C.assign_clusters(logs, protos, 0.6, block_rows, broadcast_bytes=bytes_)
    want = seeds_model([(i, v) for i, _, v in rows], [(i, v) for i, _, v in known], 0.6)
    assert sorted(int(r.medoid_document.split()[1]) for r in created.collect()) == want
    got = assigned.collect()
    assert len(got) == len(rows) and all(r.distance <= 0.6 for r in got)


def test_relabel_keeps_what_was_not_learned(spark):
    protos = spark.createDataFrame([("linux", "a", "disk", "keyword_rules", None), ("linux", "b", "cpu", "online", "old")], "os string, cluster_id string, label string, rationale string, solution string")
    results = spark.createDataFrame([("linux", "b", 1, "raid", "swap"), ("linux", "b", 2, "power", "")], "os string, cluster_id string, ts int, failure_type string, recommendation string")
    got = {r.cluster_id: (r.label, r.rationale, r.solution) for r in C.relabel_prototypes(protos, results).collect()}
    assert got == {"a": ("disk", "keyword_rules", None), "b": ("power", "llm_cluster", "old")}


def test_embedders(spark):
    df = spark.createDataFrame([("Disk failed",), ("disk FAILED",), (None,), ("",)], "t string")
    own = [r.embedding for r in B.embed_text(df, "t").collect()]
    assert own[0] == own[1] and len(own[0]) == B.DIMENSIONS and sum(own[2]) == 0.0
    given = B.embed_text(df, "t", embedder=lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]).collect()
    assert given[0].embedding == [0.6, 0.8] and given[3].embedding == [0.0, 0.0]


def test_zero_vector_norm(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.unit(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_equal_vectors_are_looked_up_once(spark, monkeypatch):
    """Issues repeat few vectors: one query for each, and of equal items the first ids alone, with the same hits."""
    kinds = [v for _, _, v in vectors(5, 21, ("linux",))]
    items = [(1000 + i, "linux", kinds[i % 4]) for i in range(200)]
    queries = [(i, "linux", kinds[i % 5]) for i in range(120)]
    seen = []

    def counted(q, i, *args, **more):
        seen.append((q.count(), i.count()))
        return K.nearest(q, i, *args, **more)

    monkeypatch.setattr(N, "nearest", counted)
    templates = frame(spark, items, "template_id").withColumn("document", F.concat(F.lit("t"), "template_id"))
    got = {}
    for r in sorted(N.template_neighbors(frame(spark, queries, "q"), templates, "q", 8).collect(), key=lambda r: (r.q, r.rank)):
        assert r.document == f"t{r.template_id}"
        got.setdefault(r.q, []).append(r.template_id)
    assert got == brute(queries, items, 8)
    logs = templates.withColumnRenamed("template_id", "log_id").drop("embedding")
    texts = templates.select("os", "document", "embedding")
    asked = frame(spark, queries, "owner_id").withColumn("q_no", F.lit(0))
    found = N.retrieve_logs(asked, logs, 5, texts=texts).collect()
    assert len(found) == 600 and {(r.owner_id, r["rank"]): r.log_id for r in found} == {(q, n + 1): i for q, hits in brute(queries, items, 5).items() for n, i in enumerate(hits)}
    assert seen == [(5, 32), (5, 20)]


def test_patterns_run_once_for_each_text(spark):
    """The label of a text is used several times, its patterns are in the plan once."""
    df = spark.createDataFrame([(["io error", "link down", "io error", "calm"],), ([],)], "t array<string>")
    out = N.classify(df, F.col("t"))
    assert [r.result for r in out.collect()] == [
        '{"is_hardware_failure":true,"failure_type":"disk","confidence":0.5,"top_signals":["disk","network"],"summary":"io error","recommendation":""}',
        '{"is_hardware_failure":false,"failure_type":"unknown","confidence":0.0,"top_signals":[],"summary":"","recommendation":""}',
    ]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AssocFail") == 1


def test_routing_is_bounded_in_memory(spark, monkeypatch):
    """However small the blocks are, a query has few copies, and no frame that leaves the routing is large."""
    items = vectors(600, 31, ("linux",))
    queries = vectors(300, 32, ("linux",))
    routed = []
    visit = K._visit
    monkeypatch.setattr(K, "_visit", lambda q, *rest: (routed.append(q.count()), visit(q, *rest))[1])
    found = K.nearest(frame(spark, queries, "q"), frame(spark, items, "i"), 3, "q", "i", broadcast_bytes=0, block_rows=2)
    got = {}
    for r in found.orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.i)
    assert got == brute(queries, items, 3)
    assert sum(routed) <= 300 * 2 * K.GROUP_BLOCKS
    assert K._rows_of_a_block(10**9, 20) == K.BLOCK_ROWS and K._rows_of_a_block(100, 20) == 20


def test_broadcast_items_are_indexed_once(spark, monkeypatch):
    """A worker that builds the index from broadcast items holds them twice."""
    sent = []
    put = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or put(self, value))
    items, queries = frame(spark, vectors(60, 2), "item"), frame(spark, vectors(20, 3), "q").repartition(4)
    found = K.nearest(queries, items, 3, "q", "item").collect()
    assert len(found) == 60 and {type(held) for held in sent[0].values()} == {K.Held}


def test_counts_are_written_as_runs(spark):
    """The work for a text follows its tokens, not the dimensions times its tokens."""
    rows = [([],), ([0],), ([63],), ([5, 5, 0, 63, 5, 62],), ([7] * 9,)]
    df = spark.createDataFrame(rows, "b array<int>")
    got = df.select(B.bucket_counts(F.col("b"), 64, False).alias("n"), B.bucket_counts(F.col("b")).alias("u")).collect()
    for (buckets,), r in zip(rows, got, strict=True):
        counts = np.bincount(buckets, minlength=64).astype(float) if buckets else np.zeros(64)
        assert r.n == counts.tolist()
        assert r.u == (counts / (np.sqrt((counts * counts).sum()) or 1.0)).tolist()


def copied(n, copies, seed, moved=0.02, dim=64):
    """Rows (id, os, vector) without structure, each with close copies, in mixed order."""
    rng = np.random.default_rng(seed)
    m = np.repeat(rng.normal(size=(n, dim)), copies, axis=0) + moved * rng.normal(size=(n * copies, dim))
    return [(i, "linux", m[j].tolist()) for i, j in enumerate(rng.permutation(n * copies))]


def test_heads_rule_out_most_pairs_and_none_that_is_near():
    m = np.array([unit(v) for _, _, v in copied(150, 3, 41)])
    heads = T.heads(m, T.axes(m[:100]))
    got = {(int(a), int(b)): int(s) for i, j, d in T.compared(m, m, heads, heads, np.full(len(m), T.least_of(0.2))) for a, b, s in zip(i, j, d, strict=True)}
    near = np.rint((1 - m @ m.T) * T.STEPS).astype(int)
    assert {p for p, s in got.items() if s <= 200_000} == set(zip(*(x.tolist() for x in np.nonzero(near <= 200_000)), strict=True))
    assert len(got) < 0.05 * len(m) ** 2


def test_clustering_vectors_without_structure_compares_few_pairs(spark):
    rows = copied(150, 4, 42)
    counted = spark.sparkContext.accumulator(0)
    got = {}
    for r in C.single_pass_cluster(frame(spark, rows, "id"), 0.2, 1, 0, broadcast_bytes=0, block_rows=60, compared=counted).collect():
        got.setdefault(r.cluster, set()).add(int(r.id))
    assert got == seed_model([(i, v) for i, _, v in rows], 0.2) and len(got) == 150
    assert 0 < counted.value < 0.15 * len(rows) ** 2


def test_earlier_near_asks_the_followers_of_a_leader(spark):
    """Far smaller tiles than usual; rows that follow a leader can be near where the leader is not."""
    rng = np.random.default_rng(43)
    base = clustered(160, ("linux", "macos"), 44, 12)
    rows = base + [(1000 + i, g, (np.array(v) * (1 + rng.random()) + 0.03 * rng.normal(size=16)).tolist()) for i, g, v in base] + [(2000, "linux", [0.0] * 16)]
    kept = K.in_order(frame(spark, rows, "id").withColumn("at", F.col("id") % 7))
    packed = kept.select(F.col("os").alias("grp"), "place", F.col("embedding").alias("vector"))
    order = {r.place: (r.os, r.id) for r in kept.collect()}
    assert [order[p] for p in sorted(order)] == sorted(order.values(), key=lambda x: (x[0], x[1] % 7, x[1]))
    vector = {i: unit(v) for i, _, v in rows}
    for limit in (0.004, 0.02):
        got = {r.place: (r.near, r.distance) for r in K.earlier_near(packed, limit, 40, tile_rows=16).collect()}
        want = {p for p, (g, i) in order.items() if any(h == g and round(1 - float(vector[i] @ vector[j]), 6) <= limit for q, (h, j) in order.items() if q < p)}
        assert set(got) == want and 20 < len(want) < len(rows)
        for p, (near, distance) in got.items():
            assert near < p and abs(distance - (1 - vector[order[p][1]] @ vector[order[near][1]])) < 2e-6


@pytest.mark.parametrize("size", [2, 40])
def test_centroids_of_packed_vectors(spark, size):
    """Clusters that are cut by batches, and members given either way."""
    rows = [(i, "linux", v) for i, _, v in vectors(200, 45)]
    members = frame(spark, rows, "id").withColumn("cluster", (F.col("id") % size).cast("string")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        plain = {r.cluster: r.centroid for r in C.centroids(members).collect()}
        same = {r.cluster: r.centroid for r in C.centroids(K.packed(members, "embedding")).collect()}
        middle = {r.cluster: r.medoid_id for r in C.medoids(members, C.centroids(members)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in range(size):
        some = {i: unit(v) for i, _, v in rows if i % size == c}
        want = unit(np.mean(list(some.values()), axis=0))
        assert np.allclose(plain[str(c)], want) and np.allclose(same[str(c)], want)
        assert middle[str(c)] == min(some, key=lambda i: (round(float(1 - some[i] @ want), 6), i))
    assert len(plain) == len(same) == size


@pytest.mark.parametrize("round_rows,bytes_", [(5000, 10**9), (0, 0)])
def test_rows_of_one_id_are_one_member(spark, round_rows, bytes_):
    rows = copied(30, 3, 46, dim=16)
    twice = rows + [r for r in rows if r[0] % 4 == 0]
    got = [tuple(r) for r in C.single_pass_cluster(frame(spark, twice, "id"), 0.2, 1, round_rows, broadcast_bytes=bytes_, block_rows=20).collect()]
    want = seed_model([(i, v) for i, _, v in rows], 0.2)
    assert sorted(got) == sorted(("linux", str(i), c) for c, ids in want.items() for i in ids)
