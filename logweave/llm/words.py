"""Words of many texts at once, as numpy arrays inside a task.

A word is a run of bytes other than space, \\t, \\n, \\v, \\f and \\r. Every word gets a 64-bit hash from
prefix sums of a polynomial over the bytes, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Texts are worked on in groups of about so many bytes; this bounds memory, not what is read.
GROUP_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts
    begin: np.ndarray  # first byte of each text
    end: np.ndarray
    doc: np.ndarray  # text of each word
    start: np.ndarray  # first byte of each word
    stop: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray  # prefix sums, for hashes of other spans


def give_back() -> None:
    """Hand memory that is free in this process back to the system.

    A Python worker lives on after its task, beside the executor that shares the limit with it; Arrow and the C library would
    keep for it what a task has used at most.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker; functions shipped by value have no lasting globals.

    A worker serves one operator after the other: what earlier ones kept is dropped and handed back, so that memories do not add up.
    """
    held = sys.modules.setdefault("logweave_worker_state", types.ModuleType("logweave_worker_state")).__dict__.setdefault("held", {})
    others = [k for k in held if k not in (name, "powers") and name != "powers"]
    for other in others:
        del held[other]
    if others:
        give_back()
    return held.setdefault(name, {})


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_state("powers")
    if len(kept.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        kept["up"] = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, _BASE, _U))])
        kept["down"] = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, inverse, _U))])
    return kept["up"], kept["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the span stands."""
    _, down = _powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) with about GROUP_BYTES each; a null text is empty."""
    first, size, part = 0, 0, []
    for i, text in enumerate(texts):
        part.append(b"" if text is None else text.encode())
        size += len(part[-1])
        if size >= GROUP_BYTES:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(lengths)
    begin = end - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    if lower:
        data = _LOWER[data]
    sums = prefix_sums(data)
    solid = ~_SPACE[data]
    at_start, at_stop = solid.copy(), solid.copy()
    if len(data):
        at_start[1:] &= ~solid[:-1]
        at_stop[:-1] &= ~solid[1:]
        full = lengths > 0
        at_start[begin[full]] = solid[begin[full]]
        at_stop[end[full] - 1] = solid[end[full] - 1]
    start, stop = np.flatnonzero(at_start), np.flatnonzero(at_stop) + 1
    doc = np.searchsorted(end, start, side="right")
    return Words(data, begin, end, doc, start, stop, span_hashes(sums, start, stop), sums)


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``size`` words inside one text."""
    n = len(w.doc) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    first = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    total = np.zeros(len(first), _U)
    factor = 1
    for k in range(size):
        factor = factor * _BASE % (1 << 64)
        total += w.hashes[first + k] * _U(factor)
    return first, mix(total + _U(size))


def per_text(w: Words, values: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sum of integer values by text."""
    return np.bincount(docs, weights=values, minlength=len(w.begin)).astype(np.int64)
