"""The filter audit against filtering in every order, row by row."""

import random
import re
from itertools import permutations

from logweave.llm import filter_audit


def model(rows, labels):
    """rows: (doc_id, text, lang)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    marks = {}
    for i, q, x in labels:
        g, b = marks.get(i, (False, False))
        marks[i] = (g or q == 1, b or x == 1)
    judged = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        good, toxic = marks.get(i, (False, False)) if i is not None else (False, False)
        judged.append((part or "", {f for f in fails if fails[f]}, good, toxic))
    out = []
    for part in {p for p, *_ in judged}:
        mine = [j[1:] for j in judged if j[0] == part]
        first = {}
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[0]]
                left = [j for j in left if f not in j[0]]
                first[f] = first.get(f, 0) + len(gone)
                before = set(order[: step - 1])
                redundant = sum(f in j[0] and bool(j[0] & before) for j in mine)
                lines.append((part, order, step, len(left), len(gone), redundant, sum(j[0] == {f} for j in mine), sum(j[1] for j in gone), sum(j[2] for j in gone)))
        out += [(*x, first[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def check(spark, rows, labels, monkeypatch=None):
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, lang string, mask string, bits string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs, marks)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == model(rows, labels)


def test_equals_filtering_in_every_order(spark, monkeypatch):
    rng = random.Random(2)
    words = ["river", "Stone", "and", "x#", "WALKS", "night\t", "\n", "é", "100%"]
    long = " ".join(f"w{k}" for k in range(250))
    rows = []
    for i in range(300):
        kind = rng.randrange(6)
        text = (long, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))), long + f" {i}", long + " A" * 60, None, f"{i} " * 210)[kind]
        rows.append((rng.choice((i, i, i, None, 7)), text, rng.choice(("en", "de", None, ""))))
    rows += [(7, long, "en"), (7, long, "en"), (None, "", None), (9, "", "en"), (10, None, "en"), (-4, " ", "fr")]
    labels = [(rng.randrange(300), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)] + [(None, 1, 1), (9, 1, 1), (9, 0, 0)]
    check(spark, rows, labels)
    # a sketch that is far too small lets more texts pass as possible repeats, and changes no figure
    monkeypatch.setattr(filter_audit, "BUCKET", 8)
    monkeypatch.setattr(filter_audit, "MAX_BUCKETS", 1)
    check(spark, rows, labels)


def test_no_rows(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(none, labels).count() == 0


def test_unique_texts_are_cleared(spark):
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(3000)] + [(5000 + i, "copy") for i in range(500)], "doc_id long, text string")
    judged = filter_audit.with_possible_repeats(docs)
    assert judged.filter("text = 'copy' and not repeats").count() == 0
    assert judged.filter("text <> 'copy' and repeats").count() < 60
