"""Token counts of a sentencepiece BPE model by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logweave.llm.stretches import text_slices
from logweave.llm.words import worker_state

#: Kept counts per Python worker; a full memory is emptied, which costs time and changes no count.
MEMORY = 400_000
_NONE = np.iinfo(np.int32).max


class Merges:
    """Symbols and pair ranks of a BPE vocabulary with byte fallback.

    Symbols are the pieces and all single characters met so far. A pair's rank is the position of the
    joined piece's score among all scores, so that pieces of one score tie, as in the library.
    """

    def __init__(self, pieces: list[str], scores: list[float]):
        ranks = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
        self.symbols: dict[str, int] = {p: i for i, p in enumerate(pieces)}
        self.known = len(pieces)
        chars = sorted({c for p in pieces for c in p} - set(self.symbols))
        for c in chars:
            self.symbols[c] = len(self.symbols)
        self.width = len(self.symbols) + 1  # one more: any character that no piece holds
        keys, rank, into = [], [], []
        for piece, score in zip(pieces, scores, strict=True):
            for cut in range(1, len(piece)):
                a, b = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.width + b)
                    rank.append(ranks[score])
                    into.append(self.symbols[piece])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.rank = np.array(rank, np.int32)[order]
        self.into = np.array(into, np.int64)[order]
        # symbol of each code point of the basic plane; others go through the dict
        self.code = np.full(1 << 16, self.width - 1, np.int64)
        self.far: dict[int, int] = {}
        for text, i in self.symbols.items():
            if len(text) == 1:
                if ord(text) < 1 << 16:
                    self.code[ord(text)] = i
                else:
                    self.far[ord(text)] = i

    @classmethod
    def of_model(cls, path: str) -> Merges:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls([sp.id_to_piece(i) for i in plain], [sp.get_score(i) for i in plain])

    def initial(self, codes: np.ndarray) -> np.ndarray:
        out = self.code[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF):
            out[i] = self.far.get(int(codes[i]), self.width - 1)
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined symbol) of each pair; a pair that is no piece has the rank _NONE."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.into[at]


def _adjacent(merges: Merges, symbols: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(len(symbols), _NONE, np.int32)
    into = np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(seq[:-1] == seq[1:])
    if len(inner):
        rank[inner], into[inner] = merges.pairs(symbols[inner], symbols[inner + 1])
    return rank, into


def _apply(merges: Merges, chosen: np.ndarray, symbols, seq, size, rank, into):
    """Join each chosen position with the next; ranks are looked up again only beside a joined symbol."""
    symbols = symbols.copy()
    size = size.copy()
    symbols[chosen] = into[chosen]
    size[chosen] += size[chosen + 1]
    keep = np.ones(len(symbols), bool)
    keep[chosen + 1] = False
    fresh = np.zeros(len(symbols), bool)
    fresh[chosen] = True
    symbols, seq, size, rank, into, fresh = symbols[keep], seq[keep], size[keep], rank[keep].copy(), into[keep].copy(), fresh[keep]
    stale = fresh.copy()
    stale[:-1] |= fresh[1:]
    at = np.flatnonzero(stale)
    rank[at] = _NONE
    at = at[at + 1 < len(symbols)]
    at = at[seq[at] == seq[at + 1]]
    rank[at], into[at] = merges.pairs(symbols[at], symbols[at + 1])
    return symbols, seq, size, rank, into, stale


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of positions in a row only every other one, from the left: pairs must not overlap."""
    run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    step = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    return at[step % 2 == 0]


def count_symbols(merges: Merges, words: list[str]) -> np.ndarray:
    """Tokens of each word: surviving symbols, an unknown character counting its bytes.

    Each round joins the pairs of the lowest rank of every word at once. Where a joined symbol opens a
    pair of that rank or a lower one, which would come first one by one, only the leftmost is joined.
    """
    counts = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seq = np.repeat(np.arange(len(words)), lengths)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(codes):
        return counts
    symbols = merges.initial(codes)
    # what a symbol counts if it stays as it is: 1, or its bytes if it is no piece
    size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    rank, into = _adjacent(merges, symbols, seq)
    while len(symbols):
        first = np.flatnonzero(np.diff(seq, prepend=-1))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(seq))))
        done = lowest == _NONE
        if done.any():
            np.add.at(counts, seq[done], np.where(symbols[done] < merges.known, 1, size[done]))
            live = ~done
            symbols, seq, size, rank, into, lowest = symbols[live], seq[live], size[live], rank[live], into[live], lowest[live]
            if not len(symbols):
                break
        chosen = _alternate(np.flatnonzero(rank == lowest))
        trial = _apply(merges, chosen, symbols, seq, size, rank, into)
        many = np.zeros(len(words), bool)
        many[seq[chosen][1:][seq[chosen][1:] == seq[chosen][:-1]]] = True
        if many.any():
            limit = np.zeros(len(words), np.int32)
            limit[seq] = lowest
            opened = trial[5] & (trial[3] <= limit[trial[1]])
            # pairs that stood there before and wait for their turn are no reason to go one by one
            bad = np.zeros(len(words), bool)
            bad[trial[1][opened]] = True
            bad &= many
            if bad.any():
                leftmost = np.diff(seq[chosen], prepend=-1) > 0
                trial = _apply(merges, chosen[leftmost | ~bad[seq[chosen]]], symbols, seq, size, rank, into)
        symbols, seq, size, rank, into, _ = trial
    return counts


_LOOSE = re.compile("▁*[^▁]+|▁+$")


def _pieces(text: str) -> list[str]:
    """Stretches that no piece crosses: marks of blanks and what follows up to the next blank, without the first mark."""
    text = text.replace("▁", " ")
    parts = text.split(" ")
    if "" in parts:
        return [x[1:] for x in _LOOSE.findall("▁" + text.replace(" ", "▁"))] if text else []
    return parts


def count_texts(texts: list[str | None], merges: Merges, memory: dict[str, int]) -> list[int]:
    parts = [_pieces(t or "") for t in texts]
    fresh = set()
    for p in parts:
        fresh.update(p)
    if len(memory) + len(fresh) > MEMORY:
        memory.clear()
    new = [x for x in fresh if x not in memory]
    for k in range(0, len(new), 50_000):
        part = new[k : k + 50_000]
        memory.update(zip(part, count_symbols(merges, ["▁" + x for x in part]).tolist(), strict=True))
    return [sum(map(memory.__getitem__, p)) for p in parts]


def token_counts(docs: DataFrame, model: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """Add ``name``: the tokens of the whole text under the sentencepiece BPE file ``model`` (long).

    No begin, end or other added tokens. A null or empty text has 0. All columns and repeated rows
    stay; a column called ``name`` is replaced. ``model`` is a path that
    every executor has. An empty table gives no rows. Texts of any length: equal stretches between blanks are counted once per task.
    """
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = StructType([*source.schema.fields, StructField(name, LongType(), False)])
    at = [c.lower() for c in kept].index(text.lower())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("token_counts")
        if model not in state:
            state[model] = (Merges.of_model(model), {})
        merges, memory = state[model]
        for batch in batches:
            for part, texts in text_slices(batch, at):
                counts = count_texts([t.decode() for t in texts], merges, memory)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*kept, name])

    return source.mapInArrow(run, schema)


def utf8_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
