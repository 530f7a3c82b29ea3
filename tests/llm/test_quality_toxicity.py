"""Measures against plain Python, label models on made votes, toxicity on rows that are not learnt from."""

import collections
import random
import re
import zlib

import numpy as np
from llm_rows import prose

from logweave.llm import quality, toxicity


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), twice, len(covered), len(set(w))


def test_measures(odd_rows):
    rng = random.Random(3)
    texts = [r[1] or "" for r in odd_rows] + ["".join(rng.choice("ab é\n#|") for _ in range(rng.randrange(80))) for _ in range(400)] + ["a b c d e f g h i\n" * 5, "\n\nx\nx\n", "x\n\nx"]
    got = quality.measure([t.encode() for t in texts])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [plain_measures(t) for t in texts]


def test_judgement(spark):
    rng = random.Random(9)
    good = [(i, ". ".join(" ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(9)).capitalize() for _ in range(6)) + ".", None) for i in range(80)]
    symbols = [(100 + i, " ".join(w + rng.choice(("###", "$$$", "%%%")) for w in prose(rng, 60).split()), None) for i in range(8)]
    shouts = [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), None) for i in range(8)]
    same = [(300, "buy this now and here at once please do\n" * 30, None), (301, "too short", None), (302, None, None), (None, good[0][1], None)]
    docs = spark.createDataFrame(good + symbols + shouts + same, "doc_id long, text string, quality string")
    kept = {r["doc_id"] for r in quality.judge_quality(docs).collect() if r["kept"]}
    assert kept == {r[0] for r in good} | {None}
    left = quality.keep_good(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == kept


def test_odd_rows_and_no_rows(odd, none):
    assert quality.judge_quality(odd).count() == odd.count()
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.judge_quality(none).count() == 0 and quality.keep_good(none).count() == 0


def test_label_model_finds_the_better_rule():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    right = np.array([0.95, 0.95, 0.95, 0.65])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[rng.random((4000, 4)) < 0.3] = 1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.fit_votes(patterns, counts.astype(float))[at]
    assert ((posterior > 0.5) == truth).mean() > 0.96


def toxic_rows(n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = prose(rng, 40).split()
        if bad:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(("idiot", "moron", "grobel" + rng.choice(("ta", "tun", "tik", "to", "tam")) + rng.choice("abc")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (None, "plain words here"), (9000, None), (9001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (9000, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    held = [(got[i]["score"] >= 0.7, bool(y)) for i, y in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[9000]["score"] == got[9001]["score"] < 0.5


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = toxic_rows(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    scores = [sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect())) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_without_labels_the_lexicon_decides(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd.select("doc_id", "text"), labels)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    docs = spark.createDataFrame([(1, "you are a stupid idiot"), (2, "a quiet river")], "doc_id long, text string")
    assert [r["score"] > 0.7 for r in toxicity.score(docs, model).orderBy("doc_id").collect()] == [True, False]


def test_labels_of_other_documents_count_for_nothing(spark):
    rng = random.Random(8)
    docs = [(i, prose(rng, 30) + (f" you zorgon{i % 5} frobnik" if i % 4 == 0 else ""), "x") for i in range(600)] + [(4, "again", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string").repartition(3)
    own = [(i, int(i % 4 == 0)) for i in range(600)]
    alone = toxicity.fit(df, spark.createDataFrame(own, "doc_id long, toxic int"), 600)
    more = toxicity.fit(df, spark.createDataFrame(own + [(10_000 + i, i % 2) for i in range(60_000)], "doc_id long, toxic int"), 600)
    assert "frobnik" in alone.words and alone.words == more.words and alone.begins == more.begins
    np.testing.assert_allclose(alone.weights, more.weights)


def test_pairs_equal_matrices():
    rng = np.random.default_rng(3)
    x = rng.random((300, 12)) < 0.2
    x[:, 5] = x[:, 4]
    fired = toxicity.Fired.of([np.flatnonzero(r) for r in x], 12)
    w, v = rng.random(300), rng.random(12)
    np.testing.assert_allclose(fired.by_text(v), x @ v)
    np.testing.assert_allclose(fired.by_voter(w), w @ x)
    assert fired.groups().tolist() == [(np.nan_to_num(np.corrcoef(x.T))[i] > toxicity.SAME_VOTE).sum() for i in range(12)]
