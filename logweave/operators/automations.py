"""Automation rules over alerts, with a cooldown per (rule, issue)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from logweave.functions import points as P, results as J, rules as R, text as T
from logweave.operators.upsert import explode_once
from logweave.session import checkpointed

# Providers that can act; a rule for another one still uses up its cooldown.
PROVIDERS = ("ansible_tower", "terraform_cloud", "servicenow")

#: Segments of a key that are composed in one row; no result depends on it.
STRETCH = 256
SEGMENT_SEC = 3600
#: Matches up to which a (rule, key) is decided in one row; no result depends on it.
KEY_ROWS = 4_096
_NEVER = -(2**62)


@dataclass(frozen=True)
class Rule:
    """A rule: what it matches and what it asks a provider to do."""

    id: str
    provider: str = ""
    failure_type: str = ""
    issue_key: str = ""
    min_confidence: float = 0.0
    params: Mapping[str, str] = field(default_factory=dict)
    cooldown: str = R.DEFAULT_COOLDOWN


def read_rules(documents: Iterable[Mapping]) -> list[Rule]:
    """Rules from their nested configuration form (id, match, action, cooldown)."""
    out = []
    for doc in documents:
        match, action = doc.get("match") or {}, doc.get("action") or {}
        out.append(
            Rule(
                id=str(doc.get("id") or "rule"),
                provider=str(action.get("provider") or ""),
                failure_type=str(match.get("failure_type") or ""),
                issue_key=str(match.get("issue_key") or ""),
                min_confidence=float(match.get("min_confidence") or 0.0),
                params={k: str(v) for k, v in (action.get("params") or {}).items()},
                cooldown=str(doc.get("cooldown") or R.DEFAULT_COOLDOWN),
            )
        )
    return out


def upsert_rule(rules: Sequence[Rule], rule: Rule) -> list[Rule]:
    """Replace the rule of the same id in place, or add it at the end."""
    if not rule.id.strip():
        raise ValueError("a rule needs an id")
    known = any(r.id == rule.id for r in rules)
    return [rule if r.id == rule.id else r for r in rules] + ([] if known else [rule])


def delete_rule(rules: Sequence[Rule], rule_id: str) -> list[Rule]:
    return [r for r in rules if r.id != rule_id]


def _action(rule: Rule, position: int, alert: Mapping[str, Column], result: Mapping[str, Column]) -> Column:
    rendered = [(k, T.render_action(F.lit(v), alert, result)) for k, v in rule.params.items()]
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(rule.id).alias("rule_id"),
        F.lit(rule.provider).alias("provider"),
        F.lit(rule.cooldown).alias("cooldown"),
        P.string_map(*rendered).alias("params"),
    )


def match_automations(alerts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per alert and matching rule: the alert's columns, rule and rendered parameters.

    Rules are few and known when the plan is built, so each one is a condition on the alert row;
    there is no join.
    """
    # a result that is no JSON object counts as empty here; only listings read it more kindly
    df = alerts.withColumn("_r", F.coalesce(J.strict_result(F.col("result")), F.parse_json(F.lit("{}"))))
    failure_type = F.coalesce(F.nullif("failure_type", F.lit("")), P.get(F.col("_r"), "$.failure_type", "string"))
    # the alert's own confidence, else a non-zero one of its result; text that is no number is 0
    own = F.nullif("confidence", F.lit(""))
    result_conf = P.variant_float(P.get(F.col("_r"), "$.confidence"))
    confidence = F.coalesce(F.when(own.isNotNull(), P.text_float(own)).otherwise(result_conf), F.lit(0.0))
    df = df.withColumns({"_type": F.coalesce(failure_type, F.lit("None")), "_conf": confidence})
    alert = {c: F.col(c) for c in ("id", "os", "issue_key", "failure_type", "confidence")}
    result = {
        c: P.get(F.col("_r"), f"$.{c}", "string")
        for c in ("is_hardware_failure", "failure_type", "confidence", "summary", "recommendation")
    }
    hits = []
    for position, rule in enumerate(rules):
        cond = F.col("_conf") >= F.lit(float(rule.min_confidence))
        if rule.failure_type:
            cond = cond & (F.col("_type") == rule.failure_type)
        if rule.issue_key:
            cond = cond & (F.coalesce(F.col("issue_key"), F.lit("None")) == rule.issue_key)
        hits.append(F.when(cond, _action(rule, position, alert, result)))
    matched = explode_once(df, F.array_compact(F.array(*hits)), "_hit")
    return matched.select(*alerts.columns, F.col("_conf").alias("match_confidence"), "_hit.*")


def with_cooldown_key(matches: DataFrame) -> DataFrame:
    """Add what the cooldown is counted by and its length in milliseconds."""
    key = F.coalesce(F.nullif("issue_key", F.lit("")), F.col("id"))
    return matches.withColumns(
        {"cooldown_key": key, "cooldown_ms": R.parse_cooldown(F.col("cooldown")) * 1000}
    )


def _next_fire(times: np.ndarray, cooldown: int) -> np.ndarray:
    """Position of the first time at least a cooldown later; ``len(times)`` if there is none."""
    return np.searchsorted(times, times + cooldown, side="left")


def _last_fire(times: np.ndarray, cooldown: int) -> np.ndarray:
    """For each start position, the last fire of the chain that starts there."""
    n = len(times)
    last, jump = np.arange(n), _next_fire(times, cooldown)
    while (jump < n).any():
        inside = jump < n
        target = jump[inside]
        new_last, new_jump = last.copy(), jump.copy()
        new_last[inside], new_jump[inside] = last[target], jump[target]
        last, jump = new_last, new_jump
    return last


def _segment_table(times: np.ndarray, start: int, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (until, fired): if the key is free from a moment up to ``until``, ``fired`` is the last fire.

    Free moments lie before the segment's start plus one cooldown, so later starts need no step.
    """
    last = _last_fire(times, cooldown)
    n = min(len(times), int(np.searchsorted(times, start + cooldown)) + 1)
    ends = np.append(last[1:n] != last[: n - 1], True)
    return times[:n][ends], times[last[:n][ends]]


def _links(until: np.ndarray, fired: np.ndarray, next_until: np.ndarray | None, cooldown: int) -> list[int]:
    """For each step of a segment, and for no fire in it (last), the step at which the next segment is entered."""
    if next_until is None:
        return [0] * (len(until) + 1)
    # a segment is eight cooldowns long: one that fires nothing leaves the next one free from its start
    return [*np.searchsorted(next_until, fired + cooldown).tolist(), 0]


def _entered(entry: int, links: list) -> list[int]:
    """The step at which each of the segments in a row is entered."""
    out = []
    for link in links:
        out.append(entry)
        entry = link[entry]
    return out


def _composed(links: list) -> list[int]:
    out = np.asarray(links[0])
    for link in links[1:]:
        out = np.asarray(link)[out]
    return out.tolist()


def _replay(times: np.ndarray, free: int, cooldown: int) -> list[int]:
    fires, at = [], int(np.searchsorted(times, free))
    while at < len(times):
        fires.append(int(times[at]))
        at = int(np.searchsorted(times, times[at] + cooldown))
    return fires


def _segment_entries(linked: DataFrame, keys: list[str], stretch: int) -> DataFrame:
    """(keys, n, entry) of segments (keys, n, link), numbered in a key: the step at which each is entered.

    Stretches of ``stretch`` segments are composed in a row each. Where a key has more of them, pointer doubling finds
    their entries: in every round the links reach twice as far, and twice as many stretches know their entry. Rounds
    are the logarithm of the stretches of a key, each an equi-join of as many rows as there are stretches.
    """
    grouped = linked.withColumn("at", F.expr(f"n div {stretch}")).groupBy(*keys, "at").agg(F.array_sort(F.collect_list(F.struct("n", "link"))).alias("row"))
    grouped = checkpointed(grouped.select(*keys, "at", F.col("row")["n"].alias("n"), F.col("row")["link"].alias("links")))
    names = "rule_id string, cooldown_key string"

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[*keys, "at"]].assign(link=[_composed(x) for x in pdf["links"]])

    most = grouped.agg(F.coalesce(F.max("at"), F.lit(0))).first()[0]
    entries = grouped.filter("at = 0").select(*keys, "at", F.lit(0).alias("entry"))
    reach = 1
    jumps = checkpointed(grouped.select(*keys, "at", "links").mapInPandas(compose, f"{names}, at bigint, link array<int>")) if most else None
    while reach <= most:
        further = entries.join(jumps, [*keys, "at"]).select(*keys, (F.col("at") + reach).alias("at"), F.get("link", F.col("entry")).alias("entry"))
        entries = checkpointed(entries.unionByName(further.join(grouped.select(*keys, "at"), [*keys, "at"], "left_semi")))
        if 2 * reach <= most:
            beyond = jumps.select(*keys, (F.col("at") - reach).alias("at"), F.col("link").alias("beyond"))
            jumps = checkpointed(jumps.join(beyond, [*keys, "at"]).select(*keys, "at", F.transform("link", lambda x: F.get("beyond", x)).alias("link")))
        reach *= 2

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[*keys, "n"]].assign(entry=[_entered(e, x) for e, x in zip(pdf["entry"], pdf["links"])])

    found = grouped.join(entries, [*keys, "at"]).select(*keys, "n", "links", "entry").mapInPandas(enter, f"{names}, n array<int>, entry array<int>")
    return found.select(*keys, F.inline(F.arrays_zip("n", "entry")))


def _replays(cut: DataFrame) -> DataFrame:
    """(rule_id, cooldown_key, ms) of the fires of rows (rule_id, cooldown_key, times, free, cooldown_ms): times from the moment it is free."""
    keys = ["rule_id", "cooldown_key"]

    def replays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fired = [_replay(t, f, c) for t, f, c in zip(pdf["times"], pdf["free"], pdf["cooldown_ms"])]
            yield pdf[keys].assign(fired=fired)

    fired = cut.select(*keys, "times", "free", "cooldown_ms").mapInPandas(replays, "rule_id string, cooldown_key string, fired array<bigint>")
    return fired.select(*keys, F.explode("fired").alias("ms"))


def cooldown_fires(
    matches: DataFrame, segment_sec: int = SEGMENT_SEC, last: DataFrame | None = None, stretch: int = STRETCH, key_rows: int = KEY_ROWS
) -> DataFrame:
    """The matches that fire: at least a cooldown after the last fire of their (rule, key).

    Whether a match fires depends on all earlier ones of its key. A key with at most ``key_rows`` matches is
    replayed in one row. One key may be very common, and is not folded in one task: its distinct times are cut into segments (eight cooldowns
    or more long). Each segment yields a short table of steps "free from t -> last fire in here"; links lead
    from each step to the step at which the next segment is entered, and are followed by doubling; then each
    segment replays its own fires from the moment it is free.

    Matches may have cooldown_key and cooldown_ms already. ``last`` has fires of before (rule_id, cooldown_key, last_ms): matches within a cooldown of them cannot fire.
    """
    keys = ["rule_id", "cooldown_key"]
    keyed = matches if {*keys, "cooldown_ms"} <= set(matches.columns) else with_cooldown_key(matches)
    rows = keyed.filter(F.col("cooldown_ms") > 0)
    if last is not None:
        free = F.col("last_ms").isNull() | (F.col("ms") - F.col("last_ms") >= F.col("cooldown_ms"))
        rows = rows.join(last.select(*keys, "last_ms"), keys, "left").filter(free).drop("last_ms")
    rows = checkpointed(rows)
    slim = rows.select(*keys, "cooldown_ms", "ms")
    large = checkpointed(slim.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > key_rows).drop("_n"))
    small = slim if large.isEmpty() else slim.join(large, keys, "left_anti")
    whole = small.groupBy(*keys).agg(F.max("cooldown_ms").alias("cooldown_ms"), F.array_sort(F.collect_set("ms")).alias("times"))
    moments = _replays(whole.withColumn("free", F.lit(_NEVER)))
    if not large.isEmpty():
        moments = moments.unionByName(_fires_by_segment(slim.join(large, keys, "left_semi"), segment_sec, stretch))
    # of several matches of a key at one time, the first fires
    w = Window.partitionBy(*keys, "ms").orderBy("seq")
    return rows.join(moments, [*keys, "ms"]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def _fires_by_segment(rows: DataFrame, segment_sec: int, stretch: int) -> DataFrame:
    """(rule_id, cooldown_key, ms) of the fires of keys with very many matches."""
    keys = ["rule_id", "cooldown_key"]
    width = F.greatest(F.lit(segment_sec * 1000), F.col("cooldown_ms") * 8)
    timed = rows.select(*keys, "cooldown_ms", "ms", width.alias("_width")).withColumn(
        "segment", F.expr("(ms - pmod(ms, _width)) div _width")
    )
    cut = timed.groupBy(*keys, "segment").agg(
        F.max("_width").alias("_width"), F.max("cooldown_ms").alias("cooldown_ms"), F.array_sort(F.collect_set("ms")).alias("times")
    )
    in_key = Window.partitionBy(*keys).orderBy("segment")
    names = "rule_id string, cooldown_key string"

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [
                _segment_table(t, s * w, c)
                for t, s, w, c in zip(pdf["times"], pdf["segment"], pdf["_width"], pdf["cooldown_ms"])
            ]
            yield pdf[[*keys, "segment", "cooldown_ms"]].assign(until=[m[0] for m in made], fired=[m[1] for m in made])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_links(*x) for x in zip(pdf["until"], pdf["fired"], pdf["next_until"], pdf["cooldown_ms"])]
            yield pdf[[*keys, "n", "segment", "cooldown_ms", "fired"]].assign(link=made)

    steps = checkpointed(cut.mapInPandas(tables, f"{names}, segment bigint, cooldown_ms bigint, until array<bigint>, fired array<bigint>"))
    numbers = steps.select(*keys, "segment").withColumn("n", F.row_number().over(in_key) - 1)
    placed = steps.join(numbers, [*keys, "segment"])
    following = placed.select(*keys, (F.col("n") - 1).alias("n"), F.col("until").alias("next_until"))
    linked = checkpointed(
        placed.join(following, [*keys, "n"], "left").mapInPandas(link, f"{names}, n int, segment bigint, cooldown_ms bigint, fired array<bigint>, link array<int>")
    )
    entered = linked.join(_segment_entries(linked.select(*keys, "n", "link"), keys, stretch), [*keys, "n"])
    until = F.get("fired", F.col("entry")) + F.col("cooldown_ms")
    free = F.coalesce(F.lag("_until").over(in_key), F.lit(_NEVER))
    entries = entered.select(*keys, "segment", until.alias("_until")).withColumn("free", free).drop("_until")
    return _replays(cut.join(entries, [*keys, "segment"]))


def actions(fires: DataFrame, dry_run: bool = True) -> DataFrame:
    """What is asked of the providers; rules for unknown providers ask nothing."""
    return fires.filter(F.col("provider").isin(*PROVIDERS)).select(
        "rule_id", "provider", F.col("id").alias("alert_id"), "issue_key", "ms", "seq", "params",
        F.lit(dry_run).alias("dry_run"),
    )


def automation_stats(acted: DataFrame) -> DataFrame:
    """Triggers and last trigger time per provider, and in total (provider null)."""
    return acted.rollup("provider").agg(F.count(F.lit(1)).alias("triggered"), F.max("ms").alias("last_ms"))
