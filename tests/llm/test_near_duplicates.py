"""Near-duplicates against all pairs, and components against a plain union-find."""

import random
import re

from logweave.llm import near_duplicates
from logweave.llm.components import connected


def brute(rows, size, percent=80):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc is not None, doc or 0), len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows))


def copies(seed=1, groups=6, n=14):
    """Groups of copies with more and more changed words: some link to the first, some to each other only."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(80)]
        for k in range(n):
            words = list(base)
            for _ in range(rng.randrange(12)):
                words[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            if k % 4 == 0:
                base = words
    return rows


def result(df):
    return sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in df.collect())


def test_equals_all_pairs(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (2, 5):
        assert result(near_duplicates.near_duplicates(docs, shingle=size)) == brute(rows, size)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    rows = copies(seed=7, groups=2, n=40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(near_duplicates.near_duplicates(docs, shingle=2)) == brute(rows, 2)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_pass_the_bitmap_before_any_join(spark, odd):
    """Spark moves a semi or an anti join below the bitmap, and with it the shuffle of all texts."""
    wanted = odd.selectExpr("cast(doc_id as long) doc_id", "xxhash64(coalesce(text, '')) text_hash").filter("doc_id is not null")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = near_duplicates.node_sets(odd, wanted, 2, "doc_id", "text")
        assert "hashpartitioning" not in sets._jdf.queryExecution().executedPlan().toString()
        assert sets.select("node").distinct().count() >= wanted.select("text_hash").distinct().count() - 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = plan(near_duplicates.keep_first(odd, shingle=2))
    assert "LeftAnti" not in left and "LeftSemi" not in left


def test_odd_rows(odd, odd_rows):
    got = near_duplicates.near_duplicates(odd, shingle=2)
    assert result(got) == brute([r[:2] for r in odd_rows], 2)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.collect())


def test_one_row_of_each_component_stays(odd):
    left = near_duplicates.keep_first(odd, shingle=2)
    assert left.columns == odd.columns
    texts = [(r["doc_id"], (r["text"] or "")[:20]) for r in left.collect()]
    assert len(texts) == len(set(texts))
    assert sum(t[1].strip() == "" for t in texts) == 4  # empty texts link with nothing: ids 1, 2, 4 and none


def test_no_rows(none):
    assert near_duplicates.near_duplicates(none).count() == 0


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(170, 170)]
    nodes = spark.createDataFrame([(i,) for i in range(0, 172)], "node long")
    got = dict(connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 if i <= 60 else 100 if 100 <= i < 160 else i for i in range(172)}
