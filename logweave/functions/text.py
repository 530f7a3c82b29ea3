"""Column functions for routing, parsing and masking log lines.

All of them are built-in Spark expressions. Java's character classes are ASCII unless asked
otherwise, so patterns carry ``(?U)`` where a text has other characters; ``(?d)`` makes ``.`` stop at a line feed only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F

# Line layouts, level words and address token.
SYSLOG_PATTERN = (
    r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[]+?)\[(\d+)\]:\s+(.*)$"
)
SERVICING_PATTERN = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}),\s+(\w+)\s+(\S+)\s+(.*)$"
LEVEL_PATTERN = r"\b(INFO|DEBUG|WARN|WARNING|ERROR|CRITICAL|ALERT)\b"
ADDRESS_PATTERN = r"((?:\d{1,3}\.){3}\d{1,3})|([A-Fa-f0-9:]{2,})"

# Masks in the order they apply, from the most specific to the most general.
MASKS: tuple[tuple[str, str], ...] = (
    (r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", "<*>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<*>"),
    (r"\b(?:[A-Fa-f0-9]{1,4}:){2,}[A-Fa-f0-9]{1,4}\b", "<*>"),
    (r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b", "<*>"),
    (r"\b0x[0-9A-Fa-f]+\b", "<*>"),
    (r"\b\d+(?:\.\d+){1,3}\b", "<*>"),
    (r"#\d+", "#<*>"),
    (r"(?<!\w)[-+]?\d+(?:\.\d+)?(?!\w)", "<*>"),
)

# What each mask needs: a text every match contains, and what a match starts with. They change no
# result; they only spare the pattern, and its costly word border, where it cannot match.
MASK_SHORTCUTS: tuple[tuple[str, str], ...] = (
    (":", r"(?=[0-9A-Fa-f]{2}:)"),
    (".", r"(?=\d)"),
    (":", r"(?=[A-Fa-f0-9]{1,4}:)"),
    ("-", r"(?=[0-9a-fA-F]{8}-)"),
    ("0x", r"(?=0x)"),
    (".", r"(?=\d)"),
    ("#", ""),
    ("", r"(?=[-+\d])"),
)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def by_alphabet(text: Column, then: Callable[[Column, str], Column]) -> Column:
    """``then(text, "")`` for a text of ASCII alone, ``then(text, "U")`` for any other.

    Within ASCII, Java's own classes and borders hold the same characters as with ``(?U)`` and cost far less.
    """
    return let(text, lambda t: F.when(is_ascii(t), then(t, "")).otherwise(then(t, "U")))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def flagged(flags: str, pattern: str) -> str:
    return f"(?{flags}){pattern}" if flags else pattern


def strip(text: Column) -> Column:
    """Drop surrounding whitespace of any kind, not only blanks."""
    return by_alphabet(text, lambda t, u: F.regexp_replace(t, r"(?U)^\s+|\s+$", "") if u else F.btrim(t, F.lit(BLANKS)))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def os_from_source(source: Column) -> Column:
    name = F.lower(source)
    return (
        F.when(name.contains("linux.log"), "linux")
        .when(name.contains("mac.log"), "macos")
        .when(name.contains("windows"), "windows")
        .otherwise("unknown")
    )


def normalize_os(name: Column, empty: str = "unknown") -> Column:
    """Aliases to one name; ``empty`` is what a blank name becomes."""
    key = F.lower(strip(or_empty(name)))
    return (
        F.when(key.isin("mac", "macos", "osx"), "macos")
        .when(key.isin("windows", "win"), "windows")
        .when(key == "", empty)
        .otherwise(key)
    )


def source_kind(source: Column) -> Column:
    return F.split_part(or_empty(source), F.lit(":"), F.lit(1))


def embedder_namespace(name: Column, embedder: Column) -> Column:
    """Table name that keeps vectors of different embedders apart."""
    suffix = F.regexp_replace(embedder, r"[^a-zA-Z0-9_-]+", "_")
    suffix = F.regexp_replace(suffix, r"^_+|_+$", "")
    return F.when(suffix == "", name).otherwise(F.concat(name, F.lit("__"), suffix))


#: Whitespace within ASCII.
BLANKS = " \t\n\x0b\f\r"

# Capture groups of the two layouts, in order.
SYSLOG_FIELDS = ("month", "date", "time", "host", "component", "pid", "content")
SERVICING_FIELDS = ("date", "time", "level", "component", "content")


def match_groups(line: Column, pattern: str, numbers: Sequence[int]) -> Column:
    """Capture groups (two or more) as an array; an array of one element where nothing matches.

    One replace puts the groups on a line each and a split takes them apart, so the pattern runs
    once per line instead of once per group. Text that itself holds a line feed is matched group
    by group.
    """

    def matched(line: Column, u: str) -> Column:
        full = flagged(u + "d", pattern)
        at_once = F.split(F.regexp_replace(line, full, "\n".join(f"${n}" for n in numbers)), "\n")
        one_by_one = F.when(
            line.rlike(full), F.array(*[F.regexp_extract(line, full, n) for n in numbers])
        ).otherwise(F.array(line))
        return F.when(line.contains("\n"), one_by_one).otherwise(at_once)

    return by_alphabet(F.rtrim(line, F.lit("\n")), matched)


def _as_struct(line: Column, pattern: str, names: tuple[str, ...]) -> Column:
    groups = match_groups(line, pattern, range(1, len(names) + 1))

    def field(found: Column, n: int) -> Column:
        value = F.get(found, F.lit(n))
        return (strip(value) if names[n] == "component" else value).alias(names[n])

    return let(
        groups, lambda g: F.when(F.size(g) > 1, F.struct(*[field(g, n) for n in range(len(names))]))
    )


def parse_syslog(line: Column) -> Column:
    """Month, date, time, host, component, pid and content; null where the line does not match."""
    return _as_struct(line, SYSLOG_PATTERN, SYSLOG_FIELDS)


def parse_servicing(line: Column) -> Column:
    """Date, time, level, component and content of a Windows servicing line."""
    return _as_struct(line, SERVICING_PATTERN, SERVICING_FIELDS)


def level_token(content: Column) -> Column:
    return F.upper(F.regexp_extract(content, "(?iU)" + LEVEL_PATTERN, 1))


def address_token(content: Column) -> Column:
    return F.regexp_extract(content, "(?U)" + ADDRESS_PATTERN, 0)


def _masked(text: Column, pattern: str, mask: str, needs: str, starts: str, u: str) -> Column:
    pattern = flagged(u, (starts if u else starts.replace(r"[-+\d]", "[-+0-9]")) + pattern)
    if not needs:
        return F.regexp_replace(text, pattern, mask)
    return let(
        text, lambda t: F.when(t.contains(needs), F.regexp_replace(t, pattern, mask)).otherwise(t)
    )


def template_content(message: Column) -> Column:
    """Replace volatile tokens by ``<*>`` and collapse whitespace."""

    def masked(text: Column, u: str) -> Column:
        for (pattern, mask), (needs, starts) in zip(MASKS, MASK_SHORTCUTS, strict=True):
            text = _masked(text, pattern, mask, needs, starts, u)
        return F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]" if u else r"\s{2,}|[\t-\r]", " ")  # a single blank is one already

    # whitespace is single blanks by then
    return F.trim(by_alphabet(message, masked))


def render_templated(component: Column, pid: Column, body: Column) -> Column:
    """``component[pid]: body`` without the parts that are empty; ``body`` is already masked."""
    bracket = F.when(or_empty(pid) != "", F.concat(F.lit("["), pid, F.lit("]"))).otherwise("")
    tail = F.when(body != "", F.concat(F.lit(": "), body)).otherwise("")
    return F.concat(component, bracket, tail)


def issue_key(os: Column, component: Column, pid: Column) -> Column:
    name = strip(F.lower(F.coalesce(component, F.lit("unknown"))))
    return F.concat_ws("|", os, name, F.coalesce(first_filled(strip(or_empty(pid))), F.lit("nopid")))


def render_action(
    template: Column, alert: Mapping[str, Column], result: Mapping[str, Column]
) -> Column:
    """Fill ``{{ alert.k }}`` and ``{{ alert.result.k }}``; unknown names stay as they are.

    A null alert field prints as ``None``; a null result field is an absent one and stays.
    """
    text = template
    for name, value in alert.items():
        shown = F.coalesce(value.cast("string"), F.lit("None"))
        text = F.replace(text, F.lit("{{ alert." + name + " }}"), shown)
    for name, value in result.items():
        mark = F.lit("{{ alert.result." + name + " }}")
        text = F.replace(text, mark, F.coalesce(value.cast("string"), mark))
    return text
