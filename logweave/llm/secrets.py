"""Secrets in texts by a trigram index.

Each rule's pattern is turned into a Boolean query over trigrams that any match must hold. An inverted
index from these trigrams to the texts is built for each block of texts; postings are united and
intersected as the query says, and only candidates are searched. A rule without a mandatory trigram
searches all texts. Letters are folded to lower case in index and query; the search itself is exact.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from logweave.llm.stretches import text_slices


class Rule(NamedTuple):
    kind: str
    pattern: str
    valid: Callable[[re.Match], bool] = lambda m: True


# The kinds every result has, in this order
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs of 16 at least: the same as all runs, the short ones dropped
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]++@"),
)
RULES = (*BASE, *MORE)

ALL = ("all",)
#: Exact strings of a part that are followed up together.
_MANY = 64


def _both(a: tuple, b: tuple) -> tuple:
    return b if a == ALL else a if b == ALL else ("and", a, b)


def _either(parts: list[tuple]) -> tuple:
    if not parts or ALL in parts:
        return ALL
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _holds(text: str) -> tuple:
    """The trigrams of one string, ASCII ones only."""
    query = ALL
    for i in range(len(text) - 2):
        if text[i : i + 3].isascii():
            query = _both(query, ("has", text[i : i + 3]))
    return query


def _of_strings(strings: set[str]) -> tuple:
    return _either([_holds(s) for s in sorted(strings)])


def _analyse(items) -> tuple[set[str] | None, tuple]:
    """(the strings that the part can be, or None if they are too many; a query that holds besides)."""
    whole: set[str] | None = {""}  # None once some piece has no exact strings
    run, query = {""}, ALL
    for op, value in items:
        exact, inner = _piece(op, value)
        query = _both(query, inner)
        if exact is not None and len(run) * len(exact) <= _MANY:
            run = {a + b for a in run for b in exact}
            continue
        query = _both(query, _of_strings(run))
        whole = None
        run = exact if exact is not None else {""}
    if whole is None:
        return None, _both(query, _of_strings(run))
    return run, query


def _piece(op, value) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        return {chr(value).lower()}, ALL
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op is sre.SUBPATTERN:
        return _analyse(value[3])
    if op is sre.BRANCH:
        parts = [_analyse(x) for x in value[1]]
        strings = set().union(*(e for e, _ in parts if e is not None))
        if all(e is not None for e, _ in parts) and len(strings) <= _MANY:
            return strings, _either([q for _, q in parts])
        return None, _either([_both(q, _of_strings(e)) if e is not None else q for e, q in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = value
        exact, inner = _analyse(body)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, ALL
        if low == 0:
            return None, ALL
        if exact is not None and low == high and len(exact) ** low <= _MANY:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in exact}
            return out, inner
        return None, _both(inner, _of_strings(exact)) if exact is not None else inner
    if op is sre.AT:
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """Boolean query over trigrams that every match of ``pattern`` fulfils; ALL if there is none."""
    exact, query = _analyse(sre_parse.parse(pattern, re.ASCII))
    return query if exact is None else _both(query, _of_strings(exact))


def trigrams(query: tuple) -> set[str]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(trigrams(q) for q in query[1:]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(texts: list[bytes], table: np.ndarray, n: int) -> np.ndarray:
    """For each trigram of the table (numbered from 1) the texts that hold it: an (n, texts) matrix."""
    out = np.zeros((n, len(texts)), bool)
    data = _FOLD[np.frombuffer(b"".join(texts), np.uint8)].astype(np.uint32)
    if len(data) < 3:
        return out
    number = table[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
    at = np.flatnonzero(number)
    end = np.cumsum([len(t) for t in texts])
    doc = np.searchsorted(end, at, side="right")
    inside = at + 3 <= end[doc]
    out[number[at[inside]].astype(np.int64) - 1, doc[inside]] = True
    return out


def candidates(query: tuple, rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query == ALL:
        return np.ones(n, bool)
    if query[0] == "has":
        return rows[query[1]]
    parts = [candidates(q, rows, n) for q in query[1:]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def search_block(texts: list[bytes], rules: tuple[Rule, ...], plans: list, table: np.ndarray, names: list[str]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text, by start, then rule."""
    rows = dict(zip(names, postings(texts, table, len(names)), strict=True))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    plain: dict[int, str] = {}
    for number, (rule, (query, compiled)) in enumerate(zip(rules, plans, strict=True)):
        for i in np.flatnonzero(candidates(query, rows, len(texts))):
            if i not in plain:
                plain[i] = texts[i].decode()
            found[i] += [(m.start(), number, m.end()) for m in compiled.finditer(plain[i]) if rule.valid(m)]
    return [[(rules[k].kind, a, b) for a, k, b in sorted(f)] for f in found]


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """Add ``name``: array of (kind, start, end) by start, then by the order of the rules.

    Positions are code points, the end exclusive; the matches of one rule are leftmost and do not
    overlap. A null or empty text has an empty array; an empty table gives no rows; texts of any length are
    searched whole. A column called ``name`` is replaced; all other
    columns and repeated rows stay.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = [c.lower() for c in kept].index(text.lower())
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    schema = StructType([*source.schema.fields, StructField(name, ArrayType(span))])
    queries = [trigram_query(r.pattern) for r in rules]
    names = sorted(set().union(*(trigrams(q) for q in queries if q != ALL)))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(names):
            a, b, c = t.encode()
            table[(a << 16) | (b << 8) | c] = i + 1
        plans = [(q, re.compile(r.pattern, re.ASCII)) for q, r in zip(queries, rules, strict=True)]
        for batch in batches:
            for rows, part in text_slices(batch, at):
                found = search_block(part, rules, plans, table, names)
                spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found], arrow)
                yield pa.RecordBatch.from_arrays([*rows.columns, spans], names=[*kept, name])

    return source.mapInArrow(run, schema)


BASE_KINDS = tuple(r.kind for r in BASE)


def span_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
