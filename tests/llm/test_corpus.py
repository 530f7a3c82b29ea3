"""Mixing, decontamination, preference pairs and the pipeline."""

import itertools
import math
import os
import random
import re

import pytest
from llm_rows import prose
from pyspark.sql import functions as F

from logweave.llm import decontamination, mixing, preferences

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    done, open_ = {}, set(names)
    while True:
        left = share * sum(sizes.values()) - sum(done.values())
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not full:
            return done | {s: left * weight[s] / total for s in open_}
        done |= {s: most * sizes[s] for s in full}
        open_ -= set(full)


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["big"] * 6 + ["a", "b", "c", "ä", None])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix_meets_its_targets(sources):
    rows, docs = sources
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs, blocks=64).taken().collect()}
    sizes, taken = {}, {}
    for i, text, source in rows:
        n = len(WORDS.findall(text))
        assert got[i]["size"] == n and got[i]["taken"] in (0, n, 2 * n)
        sizes[source] = sizes.get(source, 0) + n
        taken[source] = taken.get(source, 0) + got[i]["taken"]
    want = plain_targets(sizes)
    for i, _, source in rows:
        assert got[i]["source_size"] == sizes[source] and abs(got[i]["target"] - want[source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 10 for s in sizes)


def test_mix_goes_on_beyond_a_document_that_does_not_fit(spark):
    # one document, or the repeated rows of one id, has half of a source's words
    rows = [(10_000 * s + i, "w " * 20, f"s{s}") for s in range(10) for i in range(1, 1001)]
    rows += [(10_000 * s, "w " * 20_000, f"s{s}") for s in range(5)] + [(10_000 * s, "w " * 20, f"s{s}") for s in range(5, 9) for _ in range(1000)]
    rows += [(None, "w " * 20, "s9")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.mix_sources(docs, blocks=64, weights=(1,))
    got = mix.taken().groupBy("doc_id", "target").agg(F.sum("taken").alias("taken")).collect()
    taken = {s: sum(r["taken"] for r in got if (90_000 if r["doc_id"] is None else r["doc_id"]) // 10_000 == s) for s in range(10)}
    assert {r["target"] for r in got} == {60_000.0} and all(0 <= 60_000 - t < 20 for t in taken.values())
    assert {r["source"]: r["n"] for r in mix.rows(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()} == {f"s{s}": t for s, t in taken.items()}


def test_mixed_rows_agree_with_what_is_taken_and_rerun(sources):
    _, docs = sources
    one, two = mixing.mix_sources(docs), mixing.mix_sources(docs.repartition(7))
    rows = one.rows(docs)
    taken = {r["doc_id"]: r["taken"] for r in one.taken().collect()}
    assert taken == {r["doc_id"]: r["taken"] for r in two.taken().collect()}
    seen = {}
    for r in rows.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + len(WORDS.findall(r["text"]))
    assert seen == {d: t for d, t in taken.items() if t}
    assert {r["mix_shard"] for r in rows.collect()} == set(range(16))
    assert one.in_shards(docs).count() == rows.count()


def test_shards_have_equal_quotas(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 90), ("c", 3), ("d", 0)], "key string, quota long")
    tickets = mixing.split_quotas(quotas, 8).collect()
    sizes = [sum(t["shard"] == s for t in tickets) for s in range(8)]
    assert sum(sizes) == 793 and max(sizes) - min(sizes) <= 3
    assert {k: sum(t["key"] == k for t in tickets) for k in "abc"} == {"a": 700, "b": 90, "c": 3}


def test_mix_of_odd_rows(odd, none):
    mix = mixing.mix_sources(odd)
    assert mix.taken().count() == odd.count()
    assert set(odd.columns) | {"mix_copy", "mix_shard", "mix_order"} == set(mix.rows(odd).columns)
    assert mixing.mix_sources(none).taken().count() == 0 and mixing.mix_sources(none).rows(none).count() == 0


def passages(rng):
    return [[f"b{rng.randrange(3000)}" for _ in range(n)] for n in (6, 9, 14, 30, 55)]


def test_leaks_with_changed_words_are_found(spark):
    rng = random.Random(6)
    items = passages(rng)
    docs, want = [], set()
    for k in range(60):
        words = prose(rng, 80).split()
        item = k % 6
        if item < 5:
            part = list(items[item])
            for _ in range(len(part) // 12):
                part[rng.randrange(len(part))] = "changed"
            words[20:20] = [w.upper() + "," if rng.random() < 0.3 else w for w in part]
            want.add((k, item))
        docs.append((k, " ".join(words)))
    docs += [(100, " ".join(items[3][:8])), (101, None), (102, ""), (None, " ".join(items[4])), (103, " ".join(items[4])), (103, " ".join(items[4]))]
    want |= {(None, 4), (103, 4)}
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in enumerate(items)), (7, None), (8, ""), (9, "too short")], "item_id long, text string")
    for limit in (1000, 0):  # broadcast, and both sides shuffled
        leaks = decontamination.find_leaks(table, bench, broadcast_seeds=limit)
        assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == want
    left = [r["doc_id"] for r in decontamination.drop_leaks(table, leaks).collect()]
    assert sorted(left) == sorted(d for d, _ in docs if (d, d) and d not in {x for x, _ in want})
    assert decontamination.mark_leaks(table, leaks).count() == len(docs)


def test_leaks_with_changes_at_every_place_are_found(spark):
    allowed = {n: n - math.ceil(min(n, 13) * 0.75) - max(n - 13, 0) for n in (*range(6, 14), 15)}
    items = [(n, " ".join(f"b{n}x{i}" for i in range(n))) for n in allowed]
    docs = []
    for n, text in items:
        for places in itertools.combinations(range(n), allowed[n]):
            words = ["changed" if i in places else w for i, w in enumerate(text.split())]
            docs.append((len(docs), n, " ".join(["before", *words, "after"])))
    # every fourth word of a long item
    items.append((500, " ".join(f"c{i}" for i in range(500))))
    docs += [(len(docs) + k, 500, " ".join("changed" if i % 4 == k else f"c{i}" for i in range(500))) for k in range(4)]
    want = {(d, n) for d, n, text in docs}
    # one change more than the rule allows
    docs += [(len(docs) + n, n, " ".join("changed" if i <= allowed[n] else f"b{n}x{i}" for i in range(n))) for n in allowed if n <= 13]
    table = spark.createDataFrame(docs, "doc_id long, n int, text string").select("doc_id", "text").repartition(4)
    leaks = decontamination.find_leaks(table, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in leaks.collect()} == want


def test_masks_are_added_where_a_placement_is_left_out():
    for n, changes, masks in ((13, 3, ("11011011",)), (8, 2, ()), (5, 1, ()), (1, 0, ()), (9, 6, ()), (40, 20, ())):
        every = decontamination.covering(n, changes, masks)
        assert every[: len(masks)] == masks
        for _ in range(300):
            kept = set(random.Random(_).sample(range(n), n - changes))
            assert any(all(at + k in kept for k, c in enumerate(m) if c == "1") for m in every for at in range(n - len(m) + 1))


def test_leaks_of_odd_and_no_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    leaks = decontamination.find_leaks(odd, bench)
    assert leaks.count() == 0 and decontamination.drop_leaks(odd, leaks).columns == odd.columns
    assert decontamination.drop_leaks(odd, leaks).count() == odd.count()
    assert decontamination.find_leaks(none, bench).count() == 0
    assert decontamination.find_leaks(odd, bench.limit(0)).count() == 0


def test_native_operators_run_no_python(spark, odd):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    mix = mixing.mix_sources(odd)
    for df in (decontamination.find_leaks(odd, bench), mix.rows(odd), mix.taken(), preferences.format_preferences(preferences.pairs_by_next_answer(preferences.conversations(turns)))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def rendered(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_preference_pairs(spark):
    a, b = [("user", "hi"), ("assistant", "hello é"), ("user", "bye"), ("assistant", "ciao")], [("user", "hi"), ("assistant", "hello é"), ("user", "bye"), ("assistant", "no")]
    rows = [(1, a, b), (2, a, a), (3, a, None), (4, [], b), (5, [("user", "x")], [("user", "y"), ("assistant", "")])]
    pairs = spark.createDataFrame(rows, "pair int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    for r in preferences.format_preferences(pairs).collect():
        _, one, two = rows[r["pair"] - 1]
        one, two, n = one or [], two or [], 0
        while n < min(len(one), len(two)) and one[n] == two[n]:
            n += 1
        assert (r["n_common"], r["prompt"], r["chosen_text"], r["rejected_text"]) == (n, rendered(one[:n]), rendered(one[n:]), rendered(two[n:]))
        for side, shown, mask in ((one, r["chosen_text"], r["chosen_mask"]), (two, r["rejected_text"], r["rejected_mask"])):
            spans = [tuple(map(int, s.split(":"))) for s in mask.split(",")] if mask else []
            assert [shown[x:y] for x, y in spans] == [t for role, t in side[n:] if role == "assistant"]


def test_conversations_with_odd_turns(spark):
    turns = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (2, 0, None, None), (2, None, "user", "first"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (None, 0, "user", "lost")]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    convs = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in preferences.conversations(table).collect()}
    assert convs == {1: [("user", "one"), ("assistant", "two")], 2: [("user", "first"), ("", "")], 3: [("assistant", "x")] * 2, None: [("user", "lost")]}
    pairs = {r["conv_id"]: [t["text"] for t in r["rejected"]] for r in preferences.pairs_by_next_answer(preferences.conversations(table)).collect()}
    assert pairs == {1: ["one", ""], 2: ["first", ""], 3: ["x", ""], None: ["lost"]}
    assert preferences.conversations(table.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    rows = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert len(rows) == counts[-1]
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:i]) for i in range(len(rows))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_pipeline_stages_take_odd_rows(spark, odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, SF)
            assert name == "token_files" or out.columns == docs.columns
            assert out.count() >= 0


def test_short_items_and_unspaced_scripts(spark):
    docs = spark.createDataFrame(
        [(1, "we saw the Blue Whale today"), (2, "a whale that is blue"), (3, "私は昨日図書館で青い本を読みました。そして帰りました"), (4, "昨日は図書館"), (5, "quiet"), (6, None), (7, "so quiet, so far")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, "blue whale"), (2, "昨日図書館で青い本を読みました"), (3, "quiet"), (4, ""), (5, None), (6, "one two three four five six seven")], "item_id long, text string")
    found = sorted(set(map(tuple, decontamination.find_leaks(docs, items).select("doc_id", "item_id").collect())))
    assert found == [(1, 1), (3, 2), (5, 3), (7, 3)]


def test_taken_words_come_from_the_shards(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, shards=8, blocks=32)
    rows = {}
    for r in mix.rows(docs).groupBy("doc_id", "mix_shard").count().collect():
        rows.setdefault(r["doc_id"], {})[r["mix_shard"]] = r["count"]
    for r in mix.taken().collect():
        given = {int(s): int(n) for s, n in (x.split(":") for x in r["shards"].split(",") if x)}
        assert given == rows.get(r["doc_id"], {}) and r["taken"] == r["size"] * sum(given.values())
    placed = mix.in_shards(docs).select(F.spark_partition_id().alias("p"), "mix_shard").distinct().collect()
    assert sorted(placed) == [(s, s) for s in range(8)]  # a shard is one task's rows
