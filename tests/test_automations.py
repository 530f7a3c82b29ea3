"""Rule matching and the cooldown fold against a plain loop."""

import json
import random

import pytest

from logweave.operators import automations as U

COLUMNS = "id string, ms long, seq long, os string, issue_key string, failure_type string, confidence string, result string"


def model(rows, cooldowns):
    last, fired = {}, set()
    for rule, key, ms, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        c = cooldowns[rule] * 1000
        if c > 0 and ((rule, key) not in last or ms - last[rule, key] >= c):
            last[rule, key] = ms
            fired.add((rule, key, ms, seq))
    return fired


@pytest.mark.parametrize("segment_sec", [1, 60, 3600, 10**9])
def test_fires_do_not_depend_on_the_segments(spark, segment_sec):
    rng = random.Random(5)
    cooldowns = {"a": 60, "b": 3600, "c": 1, "never": 0}
    texts = {"a": "1m", "b": "1h", "c": "1s", "never": "0m"}
    rows, ms = [], -500_000
    for seq in range(1500):
        ms += rng.choice([0, 0, 1, 400, 1000, 59_999, 60_000, 60_001, 30, 3_600_000])
        rows.append((rng.choice("aabc") if seq % 50 else "never", "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", ms, seq))
    df = spark.createDataFrame([(r, k, m, s, f"{m}-{s}", texts[r]) for r, k, m, s in rows], "rule_id string, issue_key string, ms long, seq long, id string, cooldown string")
    got = U.cooldown_fires(df, segment_sec).collect()
    for stretch in (1, 3):
        assert sorted(U.cooldown_fires(df, segment_sec, stretch=stretch).collect()) == sorted(got)
    assert {(r.rule_id, r.issue_key, r.ms, r.seq) for r in got} == model(rows, cooldowns)
    assert len(got) == len({(r.rule_id, r.issue_key, r.ms, r.seq) for r in got})


def test_match_uses_own_values_before_those_of_the_result(spark):
    result = json.dumps({"failure_type": "power", "confidence": 0.9, "summary": "s"})
    rows = [
        ("1", 1, 1, "linux", "k", "", "", result), ("2", 2, 2, "linux", "k", "disk", "", result), ("3", 3, 3, "linux", "k", "", "0.5", result),
        ("4", 4, 4, "linux", "k", "", "high", result), ("5", 5, 5, "linux", None, "power", "1", "broken"), ("6", 6, 6, "linux", "k", "power", " 0.8 ", None),
    ]
    rules = [U.Rule("p", "servicenow", failure_type="power", min_confidence=0.7), U.Rule("key", "x", issue_key="k", min_confidence=0.0)]
    got = U.match_automations(spark.createDataFrame(rows, COLUMNS), rules).collect()
    assert sorted(r.id for r in got if r.rule_id == "p") == ["1", "5", "6"]
    assert sorted(r.id for r in got if r.rule_id == "key") == ["1", "2", "3", "4", "6"]


def test_rule_files():
    docs = [{"id": "a", "match": {"failure_type": "power", "min_confidence": 0.7}, "action": {"provider": "servicenow", "params": {"urgency": 2}}}, {"match": None, "cooldown": "1h"}]
    rules = U.read_rules(docs)
    assert rules[0] == U.Rule("a", "servicenow", failure_type="power", min_confidence=0.7, params={"urgency": "2"}, cooldown="15m")
    assert (rules[1].id, rules[1].cooldown) == ("rule", "1h")
    replaced = U.upsert_rule(rules, U.Rule("a", "x"))
    assert [r.provider for r in replaced] == ["x", ""] and len(U.upsert_rule(rules, U.Rule("new"))) == 3
    assert [r.id for r in U.delete_rule(rules, "a")] == ["rule"]
    with pytest.raises(ValueError):
        U.upsert_rule(rules, U.Rule(" "))


@pytest.mark.parametrize("segment_sec,stretch", [(1, 2), (60, 256), (10**9, 1)])
def test_large_and_small_keys_fire_alike(spark, monkeypatch, segment_sec, stretch):
    """A key with few matches is decided in one row, without segments; cut into segments it gives the same."""
    rows = [(f"{i}", "r", f"k{i % 3 if i % 5 else 9}", (i * i * 37_003) % 40_000_000, i, "10m", "p") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, rule_id string, issue_key string, ms long, seq long, cooldown string, provider string")
    cut = U.cooldown_fires(df, segment_sec, stretch=stretch, key_rows=0).collect()
    mixed = U.cooldown_fires(df, segment_sec, stretch=stretch, key_rows=70).collect()

    def none(*_):
        raise AssertionError("no key is large")

    monkeypatch.setattr(U, "_fires_by_segment", none)
    whole = U.cooldown_fires(df, segment_sec, stretch=stretch).collect()
    assert sorted(cut) == sorted(mixed) == sorted(whole) and 0 < len(whole) < 300
