"""Exact top-k search against scores of all pairs."""

import random

from logweave.llm import topk


def model(rows, k, every):
    """rows: (vec_id, weights), each a row of its own."""
    out = []
    for n, (q, w) in enumerate(rows):
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(w, v)), i is None, i or 0, i) for m, (i, v) in enumerate(rows) if m != n]
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(7)
    same = [rng.randrange(-3, 4) for _ in range(6)]
    # a third of all rows are one vector; small weights tie often, many are zero; an id stands on several rows, or is null
    rows = [(i, same if i % 3 == 0 else [rng.choice((0, 0, -2, -1, 1, 2)) for _ in range(rng.choice((6, 6, 0, 3)))]) for i in range(400)]
    rows += [(20, same), (20, same), (-10, [1] * 6), (None, same), (None, [2] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, weights array<long>").repartition(4)
    for block, queries, scores in ((topk.CANDIDATE_TERMS, topk.QUERY_ROWS, topk.SCORES), (300, 7, 64)):
        monkeypatch.setattr(topk, "CANDIDATE_TERMS", block)
        monkeypatch.setattr(topk, "QUERY_ROWS", queries)
        monkeypatch.setattr(topk, "SCORES", scores)
        assert found(topk.top_k(df, 10, 10)) == model(rows, 10, 10)


def test_few_rows(spark):
    schema = "vec_id long, weights array<long>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1])], schema)).count() == 0
    assert found(topk.top_k(spark.createDataFrame([(0, [1]), (1, [5])], schema))) == [repr((0, 1, 1, 5))]


def test_rows_that_take_no_part(spark):
    rows = [(0, [0.5, -0.0001], "x"), (1, None, "x"), (2, [None, 1.0], "x"), (3, [float("nan"), 1.0], "x"), (4, [float("inf")], "x"), (5, [], "x"), (6, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weights string")
    assert sorted(map(tuple, topk.quantized(df).collect())) == [(0, [512, -1]), (5, []), (6, [1024])]
