"""How the tokens of two tokenizers meet: groups between common ends, links of overlapping tokens, and how
often an id pair is linked in the corpus.

Most tokens of two subword vocabularies agree one to one. From a common end the arrays of token ends are
compared at the current shift of their indices, in stretches that double as long as they are equal and halve
after that; only where they differ a group is walked token by token, which gives the next shift. Stretches that
no token crosses, on either side, are aligned once for each worker, all new ones of a block of texts on end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logweave.llm.stretches import IdStore, cut_texts, ragged, text_slices
from logweave.llm.words import worker_state
from logweave.session import checkpointed

#: Kept stretches per Python worker; a full memory forgets, which costs time and changes no result.
MEMORY = 400_000
#: Id pairs that are broadcast at most. Of more pairs only those in so large a share of all links are, which
#: cannot be more than this number either; the rest is joined by a shuffle.
BROADCAST_PAIRS = 1 << 20

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def _bytes_of_chars() -> dict[str, int]:
    """Byte of each character in which a byte-level vocabulary is written: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bytewise:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        of = _bytes_of_chars()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocab = {p: i for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if p not in special}
        self.entries = {i: bytes(of[c] for c in p) for p, i in vocab.items()}
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary by ranks, where ids ascend in the order of merges and the usual pattern splits."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        split = model["pre_tokenizer"] or {}
        merges = model["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        first = len(self.entries) - len(joined)
        vocab = model["model"]["vocab"]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or [vocab[j] for j in joined] != [*range(first, first + len(joined))]:
            return None
        import public_tokenizers
        import tiktoken

        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks={e: i for i, e in self.entries.items()}, special_tokens={})

    def encode(self, stretches: list[bytes]) -> list:
        texts = [s.decode() for s in stretches]
        if self.ranked:
            return [self.ranked.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece file. It puts a space before a text itself, so a stretch goes without its own."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = {}
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.entries[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, stretches: list[bytes]) -> list:
        return self.model.encode([s[1:].decode() for s in stretches], num_threads=1)


class Side:
    """One tokenizer and the sizes of its tokens in bytes."""

    def __init__(self, model):
        self.entries, self.encode = model.entries, model.encode
        self.sizes = np.zeros(max(model.entries) + 1, np.int64)
        self.sizes[list(model.entries)] = [len(e) for e in model.entries.values()]
        self.names = [str(i) for i in range(len(self.sizes))]

    def spelled(self, stretches: list[bytes], coded: list) -> list[bool]:
        entry = self.entries.__getitem__
        return [b"".join(map(entry, ids)) == s for s, ids in zip(stretches, coded, strict=True)]


def diagonal_runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[list, list]:
    """Groups of two token sequences over the same bytes, from their ascending ends.

    Returns runs (i, j, n): the n tokens from i and from j are one to one; and groups (i, i', j, j') of
    other sizes between common ends, in order of their places. Every common end closes a group.
    """
    n = len(ends_a)
    x, y = ends_a.astype(np.int32).tobytes(), ends_b.astype(np.int32).tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    runs, groups = [], []
    i = j = 0
    while i < n:
        low, shift, step, grows = 4 * i, 4 * (j - i), 4, True
        while step >= 4:
            if x[low : low + step] == y[low + shift : low + shift + step] and low + step <= 4 * n:
                low += step
                step = step * 2 if grows else step // 2
            else:
                grows = False
                step //= 2
        low //= 4
        if low > i:
            runs.append((i, j, low - i))
            i, j = low, low + shift // 4
            if i == n:
                break
        p, q = i, j
        end, other = a[p], b[q]
        while end != other:
            if end < other:
                p += 1
                end = a[p]
            else:
                q += 1
                other = b[q]
        groups.append((i, p + 1, j, q + 1))
        i, j = p + 1, q + 1
    return runs, groups


def group_links(groups: list, ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Indices of all overlapping tokens inside the groups that are not one to one."""
    left, right = [], []
    for i, last_i, j, last_j in groups:
        while True:
            left.append(i)
            right.append(j)
            end, other = ends_a[i], ends_b[j]
            if end < other:
                i += 1
            elif end > other:
                j += 1
            else:
                break
        assert i + 1 == last_i and j + 1 == last_j
    return left, right


class Aligner:
    """Aligns texts stretch by stretch: both sides end a token at the ends of a stretch, so each distinct one is
    aligned once, all new ones of a block on end."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.heads = [f"{x}|" for x in a.names]
        # links as id pairs; tokens of A and of B, groups, and the groups as text; no tokens where a side does not spell the bytes
        self.store = IdStore(self._align, MEMORY, more=4)

    def _align(self, stretches: list[bytes]) -> tuple[list, list, list, list, list]:
        a, b = self.a, self.b
        coded_a, coded_b = a.encode(stretches), b.encode(stretches)
        fair = [x and y for x, y in zip(a.spelled(stretches, coded_a), b.spelled(stretches, coded_b), strict=True)]
        coded_a, coded_b = ([ids if f else () for ids, f in zip(coded, fair, strict=True)] for coded in (coded_a, coded_b))
        n_a, n_b = list(map(len, coded_a)), list(map(len, coded_b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(c), np.int64) for c in (coded_a, coded_b))
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        runs, groups = diagonal_runs(ends_a, ends_b)
        run = np.array(runs, np.int64).reshape(-1, 3)
        left, right = group_links(groups, ends_a.tolist(), ends_b.tolist())
        link_a = np.concatenate([ragged(run[:, 0], run[:, 2]), np.array(left, np.int64)])
        link_b = np.concatenate([ragged(run[:, 1], run[:, 2]), np.array(right, np.int64)])
        order = np.argsort(link_a, kind="stable")
        pairs = (ids_a[link_a] * len(b.sizes) + ids_b[link_b])[order]
        of_a = np.repeat(np.arange(len(stretches)), n_a)
        links = np.bincount(of_a[link_a], minlength=len(stretches))
        starts = np.sort(np.concatenate([ragged(run[:, 0], run[:, 2]), np.array([g[0] for g in groups], np.int64)]))
        n_groups = np.bincount(of_a[starts], minlength=len(stretches)).tolist()
        shown = self._shown(runs, groups, ids_a.tolist(), ids_b.tolist())
        at = np.cumsum([0, *n_groups]).tolist()
        texts = [";".join(shown[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        cut = np.cumsum([0, *links.tolist()]).tolist()
        flat = pairs.tolist()
        return [flat[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], n_a, n_b, n_groups, texts

    def _shown(self, runs: list, groups: list, ids_a: list[int], ids_b: list[int]) -> list[str]:
        name_a, name_b, head = self.a.names.__getitem__, self.b.names.__getitem__, self.heads.__getitem__
        shown: list[str] = []
        run_at = iter(runs)
        run = next(run_at, None)
        for group in [*groups, None]:
            while run and (group is None or run[0] < group[0]):
                i, j, n = run
                shown += map(add, map(head, ids_a[i : i + n]), map(name_b, ids_b[j : j + n]))
                run = next(run_at, None)
            if group:
                i, i2, j, j2 = group
                shown.append(",".join(map(name_a, ids_a[i:i2])) + "|" + ",".join(map(name_b, ids_b[j:j2])))
        return shown

    def align(self, texts: list[bytes]) -> dict[str, np.ndarray | list]:
        """Counts, digest and distinct linked id pairs of each text; see ``align_tokens``."""
        n, store = len(texts), self.store
        cut = cut_texts([b" " + t if t else b"" for t in texts])
        slots = store.of(cut)
        text = np.repeat(np.arange(n), cut.counts)
        n_a, n_b, n_groups, shown = store.more
        fair = np.ones(n, bool)
        chosen = slots.tolist()
        of_a, of_b, of_groups = (np.fromiter(map(x.__getitem__, chosen), np.int64, len(chosen)) for x in (n_a, n_b, n_groups))
        fair[text[of_a == 0]] = False
        size = np.where(fair[text], store.size[slots], 0)
        link_doc = np.repeat(text, size)
        wide, tall = len(self.b.sizes), len(self.a.sizes)
        key, times = np.unique(link_doc * (tall * wide) + store.flat[ragged(store.first[slots], size)], return_counts=True)
        pair_doc, pair = np.divmod(key, tall * wide)
        at = np.cumsum([0, *cut.counts.tolist()]).tolist()
        digests = [hashlib.sha256(";".join(map(shown.__getitem__, chosen[x:y])).encode()).hexdigest() if ok and y > x else "" for x, y, ok in zip(at[:-1], at[1:], fair.tolist(), strict=True)]

        def total(values: np.ndarray) -> np.ndarray:
            return np.where(fair, np.bincount(text, values, n), 0).astype(np.int64)

        return {
            "n_a": total(of_a), "n_b": total(of_b), "n_groups": total(of_groups), "n_links": np.bincount(link_doc, minlength=n),
            "groups_sha256": digests, "pairs": np.bincount(pair_doc, minlength=n), "a": pair // wide, "b": pair % wide, "times": times,
        }


def align_tokens(docs: DataFrame, bytewise: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of ``docs``: ``ALIGNED``.

    A encodes a space and the text by the byte-level file ``bytewise``, B the text by the sentencepiece file
    ``pieces``, both without added tokens and with strings of special tokens as plain text; both are paths that
    every executor has. Groups lie between the places where tokens of A and B both end, links are all
    pairs of tokens that share a byte. ``a``, ``b``, ``times`` are the distinct linked id pairs and how often they
    are linked. A null or empty text, and one that either side does not spell byte by byte, has no tokens, zeros, an
    empty digest and empty lists. Repeated rows and ids stay rows of their own; an empty table gives none.
    """
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("alignment")
        if (bytewise, pieces) not in state:
            state[bytewise, pieces] = Aligner(Side(Bytewise(bytewise)), Side(Pieces(pieces)))
        aligner = state[bytewise, pieces]
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                found = aligner.align(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(found["pairs"])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(found[c].astype(np.int32))) for c in ("a", "b", "times")]
                counts = [pa.array(found[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(found["groups_sha256"], pa.string()), *lists], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return source.mapInArrow(run, ALIGNED)


def _links(aligned: DataFrame) -> DataFrame:
    key = F.transform(F.arrays_zip("a", "b"), lambda p: F.shiftleft(p["a"].cast("long"), 32) + p["b"])
    return aligned.select("row", F.inline(F.arrays_zip(key.alias("pair"), F.col("times").alias("times")))).toDF("row", "pair", "times")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows an id pair is linked, and whether none of its A id is in more."""
    seen = aligned.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    # the pairs of one A id are no more than the vocabulary of B
    return seen.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def link_scores(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``align_tokens`` without its lists, with n_best (links of a pair that is the most frequent of its A id, ties
    included) and count_sum (the sum of the corpus-wide counts of all links)."""
    rows = checkpointed(aligned.withColumn("row", F.monotonically_increasing_id()))
    counts = checkpointed(pair_counts(rows).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "n", "best"))
    size = counts.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    links = _links(rows)
    if size["pairs"] <= broadcast_pairs:
        met = links.join(F.broadcast(counts), "pair")
    else:
        often = F.col("n") > size["links"] // broadcast_pairs
        hot = F.broadcast(counts.filter(often))
        met = links.join(hot, "pair").unionByName(links.join(hot, "pair", "left_anti").join(counts.filter(~often), "pair"))
    scored = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    slim = rows.drop("a", "b", "times").join(scored, "row", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum")}
    return slim.withColumns(zero).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
