"""Alignment of two tokenizers against the libraries and a plain walk over the bytes."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import sentencepiece
from llm_rows import prose
from tokenizers import Tokenizer

from logweave.llm import alignment
from logweave.llm.stretches import cut_texts

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    """(ids, bytes) of both sides, by the libraries."""
    tok = tokens.tok = getattr(tokens, "tok", None) or Tokenizer.from_file(BYTES)
    tok.encode_special_tokens = True
    sp = tokens.sp = getattr(tokens, "sp", None) or sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of = alignment._bytes_of_chars()
    e = tok.encode(" " + text, add_special_tokens=False)
    ids = sp.encode(text)
    return (e.ids, [bytes(of[c] for c in t) for t in e.tokens]), (ids, [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids])


def model(texts):
    """The contract, byte by byte: every pair of tokens that share a byte is a link."""
    docs = []
    for text in texts:
        (ia, ba), (ib, bb) = tokens(text) if text else (([], []), ([], []))
        if not text or b"".join(ba) != b"".join(bb) or b"".join(ba) != (" " + text).encode():
            docs.append(None)
            continue
        owner_a, owner_b = [i for i, x in enumerate(ba) for _ in x], [i for i, x in enumerate(bb) for _ in x]
        links = sorted(set(zip(owner_a, owner_b)))
        cuts = set(np.cumsum(list(map(len, ba)))) & set(np.cumsum(list(map(len, bb))))
        groups, a, b, at_a, at_b = [], [], [], 0, 0
        for end in sorted(cuts):
            a, b = [], []
            while at_a < len(ba) and sum(map(len, a)) + len(b"".join(ba[:at_a])) - len(b"".join(a)) < end and len(b"".join(ba[: at_a + 1])) <= end:
                a.append(ba[at_a])
                at_a += 1
            while at_b < len(bb) and len(b"".join(bb[: at_b + 1])) <= end:
                b.append(bb[at_b])
                at_b += 1
            groups.append((ia[at_a - len(a) : at_a], ib[at_b - len(b) : at_b]))
        docs.append((ia, ib, [(ia[i], ib[j]) for i, j in links], groups))
    counts = {}
    for d in docs:
        for pair in set(d[2] if d else ()):
            counts[pair] = counts.get(pair, 0) + 1
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ia, ib, links, groups = d
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(ia), len(ib), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


def rows_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, *list(r)[1:]) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def odd_texts(n):
    rng = random.Random(11)
    parts = ["a", "é", "日本", "𐍈", "  ", " ", "\n", "\t", "▁", "<|endoftext|>", "<0x0A>", "</s>", "word", "don't", "12,345", "…", " ", "　x", "über", "ﬁ", "\x00", "ab" * 40, " ing", "naïve"]
    return ["".join(rng.choice(parts) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_equals_the_plain_walk(spark):
    rng = random.Random(3)
    texts = [*odd_texts(250), *(prose(rng, k) for k in (1, 5, 80, 200)), None, "", " ", "the the", "the the", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = sorted((i, *r) for i, r in enumerate(model(texts)))
    aligned = alignment.align_tokens(docs, BYTES, PIECES)
    assert rows_of(alignment.link_scores(aligned)) == want
    # more pairs than may be broadcast: frequent ones are, the others are shuffled
    assert rows_of(alignment.link_scores(aligned, broadcast_pairs=40)) == want


def test_odd_rows_and_clashing_columns(odd, odd_rows, none):
    got = rows_of(alignment.link_scores(alignment.align_tokens(odd, BYTES, PIECES)))
    short = [r for r in odd_rows if len(r[1] or "") < 2_000]
    assert len(got) == len(odd_rows)
    for r in short:
        (ia, _), (ib, _) = tokens(r[1]) if r[1] else (([], 0), ([], 0))
        assert any(g[:3] == (r[0] if r[0] is not None else -1, len(ia), len(ib)) for g in got)
    assert all(g[4] == g[1] + g[2] - g[3] for g in got)  # inside a group a walk has one link less than tokens
    assert rows_of(alignment.link_scores(alignment.align_tokens(none, BYTES, PIECES))) == []


def test_runs_are_whole():
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 64, 1000):
        for share in (0.0, 0.05, 0.5, 1.0):
            ends = np.arange(1, size + 1) * 3
            a = np.unique(np.concatenate([ends, rng.integers(1, 3 * size + 1, int(share * size))]))
            b = np.unique(np.concatenate([ends[rng.random(size) > share / 2], [3 * size]]))
            runs, groups = alignment.diagonal_runs(a, b)
            common = set(a) & set(b)
            closed = [a[i + k] for i, _, n in runs for k in range(n)] + [a[g[1] - 1] for g in groups]
            assert sorted(closed) == sorted(common)
            assert all(a[i + k] == b[j + k] for i, j, n in runs for k in range(n))
            assert all(g[1] - g[0] + g[3] - g[2] > 2 for g in groups)


def test_stretches_tile_the_texts():
    texts = [t.encode() for t in odd_texts(200)] + [b"", b" ", b"a b a b", b"x  y z\n q"]
    cut = cut_texts(texts)
    assert b"".join(cut.distinct[i] for i in cut.which) == b"".join(texts)
    assert len(set(cut.distinct)) == len(cut.distinct)
    at = np.concatenate([[0], np.cumsum(cut.counts)])
    assert [b"".join(cut.distinct[i] for i in cut.which[a:b]) for a, b in zip(at[:-1], at[1:])] == texts
