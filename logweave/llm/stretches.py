"""Texts cut where no token of a byte-level or sentencepiece BPE crosses, and ids kept for each distinct cut.

A stretch begins at the start of a text and at every single space that follows something else than a space
and stands before a character that is no blank. No pattern of a byte-level BPE lets a token reach from
before such a space to behind it, and no sentencepiece token holds the mark of a space behind another
character; so the ids of a text are those of its stretches, one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logweave.llm.words import GROUP_BYTES, prefix_sums, span_hashes

#: Bytes that may begin a blank of any script: a space before one of these begins no stretch.
_MAY_BE_BLANK = np.zeros(256, bool)
_MAY_BE_BLANK[[*range(9, 14), *range(28, 33), 0x85, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Stretches(NamedTuple):
    distinct: list[bytes]
    which: np.ndarray  # index into ``distinct`` of every stretch
    counts: np.ndarray  # stretches of every text


def text_slices(batch: pa.RecordBatch, at: int, size: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about ``size`` bytes of column ``at``, each with its texts (null: empty).

    Only the texts of one slice are Python objects at a time.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    filled = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
    # what the arrays of this batch used goes back to the system before the next one comes
    pa.default_memory_pool().release_unused()


def cut_texts(texts: list[bytes]) -> Stretches:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    if not len(data):
        return Stretches([], np.zeros(0, np.int64), np.zeros(len(texts), np.int64))
    end = np.cumsum(lengths)
    begin = end - lengths
    opens = data == 32
    opens[1:] &= data[:-1] != 32
    opens[:-1] &= ~_MAY_BE_BLANK[data[1:]]
    opens[end[lengths > 0] - 1] = False
    opens[begin[lengths > 0]] = True
    start = np.flatnonzero(opens)
    stop = np.append(start[1:], len(data))
    hashes = span_hashes(prefix_sums(data), start, stop)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(np.searchsorted(end, start, side="right"), minlength=len(texts))
    # equal hashes are compared byte by byte
    twin = start[first][which]
    size = stop - start
    same = size == size[first][which]
    if same.all():
        same = data == data[np.arange(len(data)) + np.repeat(twin - start, size)]
    if not same.all():
        slots: dict[bytes, int] = {}
        which = np.array([slots.setdefault(whole[a:b], len(slots)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)], np.int64)
        return Stretches(list(slots), which, counts)
    return Stretches([whole[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)], which, counts)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges that begin at ``first`` and are ``size`` long, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


class IdStore:
    """Ids of distinct stretches in one flat array, and what else ``encode`` tells of each.

    ``encode`` gives the ids of all stretches on end and their number for each, as arrays, or a list of ids for each stretch;
    then lists with one value a stretch (``more`` of them). A full
    store keeps the half that was met most often and forgets the rest, which costs time and changes no id.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple], limit: int, more: int = 0):
        self.encode, self.limit = encode, limit
        self._hold({}, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0, [[] for _ in range(more)])

    def _hold(self, slot: dict[bytes, int], flat: np.ndarray, size: np.ndarray, met: np.ndarray, used: int, more: list[list]) -> None:
        self.slot, self.flat, self.size, self.met, self.used, self.more = slot, flat, size, met, used, more
        self.first = np.cumsum(size) - size

    def _shrink(self) -> None:
        n = len(self.slot)
        kept = np.sort(np.argsort(-self.met[:n], kind="stable")[: self.limit // 2])
        kept = kept[self.met[kept] > 1]
        order = kept.tolist()
        of = dict(zip(order, range(len(order)), strict=True))
        slot = {k: of[s] for k, s in self.slot.items() if s in of}
        flat, size = self.flat[ragged(self.first[kept], self.size[kept])], self.size[kept]
        self._hold(slot, flat, size, np.ones(len(kept), np.int64), len(flat), [[m[i] for i in order] for m in self.more])

    def _grown(self, array: np.ndarray, need: int) -> np.ndarray:
        return array if need <= len(array) else np.concatenate([array, np.zeros(max(need, 2 * len(array)) - len(array), array.dtype)])

    def slots(self, distinct: list[bytes]) -> np.ndarray:
        found = list(map(self.slot.get, distinct))
        new = [d for d, s in zip(distinct, found, strict=True) if s is None]
        if new and len(self.slot) + len(new) > self.limit and self.slot:
            self._shrink()
            found = list(map(self.slot.get, distinct))
            new = [d for d, s in zip(distinct, found, strict=True) if s is None]
        if new:
            coded, *more = self.encode(new)
            for held, values in zip(self.more, more, strict=True):
                held += values
            if isinstance(coded, tuple):
                ids, size = coded
            else:
                size = np.fromiter(map(len, coded), np.int64, len(coded))
                ids = np.fromiter(chain.from_iterable(coded), np.int64, int(size.sum()))
            n, k = len(self.slot), self.used + len(ids)
            self.flat = self._grown(self.flat, k)
            self.first, self.size, self.met = (self._grown(x, n + len(new)) for x in (self.first, self.size, self.met))
            self.flat[self.used : k] = ids
            self.size[n : n + len(new)] = size
            self.first[n : n + len(new)] = self.used + np.cumsum(size) - size
            self.met[n : n + len(new)] = 0
            self.slot.update(zip(new, range(n, n + len(new)), strict=True))
            self.used = k
            fresh = iter(range(n, n + len(new)))
            found = [next(fresh) if s is None else s for s in found]
        return np.array(found, np.int64)

    def of(self, cut: Stretches) -> np.ndarray:
        """The slot of every stretch."""
        distinct = self.slots(cut.distinct)
        self.met[distinct] += np.bincount(cut.which, minlength=len(distinct))
        return distinct[cut.which]

    def ids(self, cut: Stretches) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, ids of each text)."""
        slots = self.of(cut)
        size = self.size[slots]
        text = np.repeat(np.arange(len(cut.counts)), cut.counts)
        return self.flat[ragged(self.first[slots], size)], np.bincount(text, weights=size, minlength=len(cut.counts)).astype(np.int64)
