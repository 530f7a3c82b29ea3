"""Token counts and token files against the libraries themselves."""

import os
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from logweave.llm import token_counts, token_files
from logweave.llm.words import worker_state
from logweave.session import fresh_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def test_counts_are_the_librarys(odd, odd_rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(odd, PIECES)
    assert set(got.columns) == set(odd.columns)  # the column that was called n_tokens is replaced
    have = sorted((r["doc_id"] or -1, r["text"] or "", r["n_tokens"]) for r in got.select("doc_id", "text", "n_tokens").collect())
    assert have == sorted((r[0] or -1, r[1] or "", len(sp.encode(r[1] or ""))) for r in odd_rows)


def test_merges_of_long_and_odd_stretches():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    merges = token_counts.Merges.of_model(PIECES)
    texts = ["a" * 3000, "ab" * 1500, " " * 60 + "x", "▁▁ ▁", "th" * 900 + "  ing", "<s></s><unk><0x0A>", "日" * 300, "é" * 99, "'s't" * 40, "\n" * 50]
    assert token_counts.count_texts(texts, merges, {}) == [len(sp.encode(t)) for t in texts]


def test_full_memory_changes_no_count(monkeypatch):
    merges = token_counts.Merges.of_model(PIECES)
    texts = [f"word{i} of number{i * 7}" for i in range(200)]
    whole = token_counts.count_texts(texts, merges, {})
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    memory: dict = {}
    assert [token_counts.count_texts([t], merges, memory)[0] for t in texts] == whole


def test_counts_of_no_rows(none):
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_files_hold_the_ids(spark, odd, odd_rows):
    folder = fresh_path(spark, "test-tokens")
    token_files.write_token_files(odd, folder, BYTES, 2, parts=4)
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(BYTES)
    want = sorted(((r[0] is not None, r[0] or 0), tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in odd_rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), list(r["ids"])) for r in got) == want
    assert [((r["doc_id"] is not None), r["doc_id"] or 0) for r in got] == [k for k, _ in want]  # ascending, nulls first
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]


def test_stretches_are_the_whole_texts():
    encoder = token_files.Encoder(BYTES)
    texts = ["a  b \n c", "it's  we're", " lead", "trail ", "x<|endoftext|> y z<|endoftext|>", "a \x1c b", "tab\t x", "", None, "one.\nTwo three"]
    check_ids(encoder, texts)
    rng = random.Random(9)
    parts = ["a", "é", "日本", "𐍈", "  ", " ", "\n", "\t", "▁", "<|endoftext|>", "'ll", "don't", "12,345", "…", "\u00a0", "　x", "\x1f", "\x85", "über", "ab" * 40, "\u2003", "!?", "S"]
    check_ids(encoder, ["".join(rng.choice(parts) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(1, 30))) for _ in range(4000)])


def check_ids(encoder, texts):
    flat, counts = encoder.ids([(t or "").encode() for t in texts])
    got = np.split(flat, np.cumsum(counts)[:-1])
    assert [g.tolist() for g in got] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_full_store_changes_no_id(monkeypatch):
    monkeypatch.setattr(token_files, "MEMORY", 5)
    check_ids(token_files.Encoder(BYTES), [f"one two three {i} four{i % 3} five" for i in range(50)])
    encoder = token_files.Encoder(BYTES)
    for i in range(20):
        check_ids(encoder, [f"one two {i} three{i % 3}", "two"])


def test_new_stretches_are_encoded_in_runs():
    """The library is called once for a run of new stretches, and gives the same ids as for each alone."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg'é.,日 12\n") for _ in range(rng.randrange(1, 12))).strip() or "x" for _ in range(3000)]
    texts = [" ".join(words[n : n + 30]) + rng.choice(["", " ", "\n", "  "]) for n in range(0, 3000, 30)]
    encoder, calls = token_files.Encoder(BYTES), []
    plain = encoder.tokenizer

    class Counted:
        def encode(self, *args, **named):
            calls.append(1)
            return plain.encode(*args, **named)

        def encode_batch_fast(self, *args, **named):
            calls.append(1)
            return plain.encode_batch_fast(*args, **named)

    encoder.tokenizer = Counted()
    flat, counts = encoder.ids([t.encode() for t in texts])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in np.split(flat, np.cumsum(counts)[:-1])] == want
    assert len(calls) < 300  # a beginning and an end of each text, and a few runs


def test_files_of_no_rows(spark, none):
    folder = fresh_path(spark, "test-tokens")
    token_files.write_token_files(none, folder, BYTES, 2, parts=2)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_dropped_state_goes_back_to_the_system():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    worker_state("first")["held"] = [np.ones(12_000) for _ in range(2_000)]  # 192 MB in pieces that the C library keeps
    above = np.ones(12_000)
    full = resident()
    worker_state("second")
    assert full - resident() > 150_000_000 and len(above)
