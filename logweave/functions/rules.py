"""Failure keyword rules, severity and cooldown texts as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from logweave.functions.text import let

# Failure rules in the order in which the first match names the label.
FAILURE_RULES: tuple[tuple[str, str], ...] = (
    (
        "disk",
        r"\b(smart|reallocated|bad sector|io error|i/o error|seek error|read error|write error"
        r"|fsck|filesystem error|disk failure|block error)\b",
    ),
    ("raid", r"\b(raid degraded|mdadm|array degraded|rebuild failed|missing member|mdmpd failed)\b"),
    ("nvme", r"\b(nvme fatal|nvme error|pci[e]? error|pcie bus error)\b"),
    ("thermal", r"\b(overheat|thermal throttle|temperature limit|over temperature)\b"),
    ("memory", r"\b(ecc error|corrected error|uncorrectable|memtest|oom killer)\b"),
    ("power", r"\b(psu|power loss|brownout|undervoltage|overvoltage)\b"),
    ("cpu", r"\b(mce|machine check|cpu stall|soft lockup|hard lockup)\b"),
    (
        "network",
        r"\b(link down|carrier lost|nic failure|packet loss|rx/tx error"
        r"|internet connection appears to be offline|no network route)\b",
    ),
    ("filesystem", r"\b(EXT3-fs: INFO: recovery required)\b"),
    ("service_failure", r"\b(xinetd.*failed to start|service.*failed to start)\b"),
    ("sandbox", r"\b(deny mach-lookup)\b"),
    ("wifi", r"\b(AssocFail)\b"),
    ("windows_update", r"\b(CBS_E_MANIFEST_INVALID_ITEM|CBS_E_INVALID_PACKAGE)\b"),
    ("storage", r"\b(storvsp)\b"),
)

# Failure-type fragments behind each severity.
CRITICAL_TYPES = ("power", "raid", "storage")
WARNING_TYPES = ("disk", "nvme", "filesystem", "cpu", "memory", "network", "thermal")

# Cooldown when the text is missing, and when it cannot be read.
DEFAULT_COOLDOWN = "15m"
FALLBACK_COOLDOWN_SEC = 900


def read_failure_rules(config: Mapping) -> tuple[tuple[str, str], ...]:
    """(name, pattern) of the ``rules`` of a configuration, in its order; without any the fixed ones."""
    found = tuple((str(r["name"]), str(r["pattern"])) for r in config.get("rules") or ())
    for _, pattern in found:
        re.compile(pattern)
    return found or FAILURE_RULES


def needed_words(pattern: str) -> list[str] | None:
    """Texts of which at least one is in everything the pattern matches; null if not plain to see.

    Only patterns of the form ``\\b(a|b|c)\\b`` are read, each alternative by its longest literal run.
    """
    body = re.fullmatch(r"\\b\(([^(){}\\]*)\)\\b", pattern)
    if body is None:
        return None
    words = []
    for alternative in body.group(1).split("|"):
        # optional parts, classes and wildcards end a run
        runs = re.split(r"\[[^\]]*\][*+?]?|\.[*+?]?|.[*?]|[\^$+]", alternative)
        words.append(max(runs, key=len).lower())
    return list(dict.fromkeys(words)) if all(w.isascii() and w for w in words) else None


def failure_labels(text: Column, rules: Sequence[tuple[str, str]] = FAILURE_RULES) -> Column:
    """Names of all rules that match, in rule order.

    Plain substring tests on the lower-cased text come first and the pattern runs only where one
    holds. Case folding beyond ASCII is left to the pattern: such text skips the substring tests.
    """

    def hit(body: Column, low: Column, name: str, pattern: str) -> Column:
        match = body.rlike("(?iUd)" + pattern)
        words = needed_words(pattern)
        if words is not None:
            maybe = F.lit(False)
            for word in words:
                maybe = maybe | low.contains(word)
            match = (low.isNull() | maybe) & match
        return F.when(match, F.lit(name))

    def labels(body: Column, low: Column) -> Column:
        return F.array_compact(F.array(*[hit(body, low, name, pattern) for name, pattern in rules]))

    def bound(body: Column) -> Column:
        ascii_only = F.octet_length(body) == F.length(body)
        return let(F.when(ascii_only, F.lower(body)), lambda low: labels(body, low))

    return let(text, bound)


def failure_signals(text: Column, rules: Sequence[tuple[str, str]] = FAILURE_RULES) -> Column:
    """Struct of has_signal, label, score and evidence for one text."""
    evidence = failure_labels(F.coalesce(text, F.lit("")), rules)
    return signal_from_labels(evidence)


def signal_from_labels(evidence: Column) -> Column:
    found = F.size(evidence)
    return F.struct(
        (found > 0).alias("has_signal"),
        F.coalesce(F.get(evidence, F.lit(0)), F.lit("unknown")).alias("label"),
        F.least(F.lit(1.0), found * F.lit(0.2)).alias("score"),
        evidence.alias("evidence"),
    )


def derive_severity(failure_type: Column) -> Column:
    name = F.lower(F.coalesce(failure_type, F.lit("")))
    return (
        F.when(name.rlike("|".join(CRITICAL_TYPES)), "critical")
        .when(name.rlike("|".join(WARNING_TYPES)), "warning")
        .otherwise("info")
    )


def parse_cooldown(text: Column) -> Column:
    """Seconds of a cooldown text: the last character is the unit, the rest the number."""
    text = F.coalesce(F.nullif(text, F.lit("")), F.lit(DEFAULT_COOLDOWN))
    unit = F.lower(F.right(text, F.lit(1)))
    # an integer text: digits with single underscores between them, one sign, outer blanks
    head = F.regexp_replace(F.left(text, F.length(text) - 1), r"(?U)^\s+|\s+$", "")
    digits = F.when(head.rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(head, F.lit("_"), F.lit("")))
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    return F.coalesce(digits.try_cast("bigint") * factor, F.lit(FALLBACK_COOLDOWN_SEC).cast("bigint"))
