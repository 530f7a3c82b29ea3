"""Quality of documents by weak supervision: rules vote good, bad or not at all.

Expectation-maximisation over the counts of vote patterns (at most 3 ** rules of them, whatever the
number of documents) estimates how often each rule's votes are right; the posterior probability of
good, not the passing of all rules, decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logweave.llm.stretches import text_slices
from logweave.llm.words import give_back, mix, per_text, span_hashes, window_hashes, words_of, worker_state
from logweave.session import checkpointed

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_U = np.uint64

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_shouts long, n_distinct long, n_plain long, n_bare long, n_ends long"


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _equal_before(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the same hash stands earlier in the same text."""
    _, first = np.unique(mix(hashes + doc.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)
    again = np.ones(len(hashes), bool)
    again[first] = False
    return again


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text."""
    w = words_of(texts)
    n = len(texts)
    data = w.data
    lead = (data & 0xC0) != 0x80
    chars, symbols = _sums(lead), _sums(_SYMBOL[data])
    upper = (data >= 65) & (data <= 90)
    upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | (data >= 0xC3) & lead
    uppers, letters = _sums(upper), _sums(letter)
    # lines: from the start of a text or behind a line feed to the next line feed or the text's end
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([w.begin, feeds + 1]), kind="stable")
    stop = np.sort(np.concatenate([w.end, feeds]), kind="stable")
    # a text's start and the place behind a line feed of the text before can be one number: pairs stay in order
    first = np.searchsorted(w.start, begin, side="left")
    full = (np.searchsorted(w.start, stop, side="left") > first) & (stop > begin)
    begin, stop = begin[full], stop[full]
    line_doc = np.searchsorted(w.end, begin, side="right")
    twice = _equal_before(line_doc, span_hashes(w.sums, begin, stop))
    # words in windows of 8 that are found twice or more
    at, window = window_hashes(w, 8)
    _, where, counts = np.unique(mix(window + w.doc[at].astype(_U) * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    often = at[counts[where] > 1] if len(at) else at
    cover = np.zeros(len(w.doc) + 9, np.int64)
    np.add.at(cover, often, 1)
    np.add.at(cover, often + 8, -1)
    covered = np.cumsum(cover)[: len(w.doc)] > 0
    # a plain word: letters, the first one upper case or not, and one mark at its end at most
    small = _sums((data >= 97) & (data <= 122) | (data >= 128))
    head = data[w.start]
    mark = _MARK[data[w.stop - 1]] & (w.stop - w.start > 1)
    plain = (w.stop - w.start) - (small[w.stop] - small[w.start]) - ((head >= 65) & (head <= 90)) - mark == 0
    bare = letters[w.stop] == letters[w.start]
    shout = (data[w.stop - 1] == 33) & (w.stop - w.start > 1) & (data[w.stop - 2] == 33)
    return {
        "n_words": np.bincount(w.doc, minlength=n).astype(np.int64),
        "word_chars": per_text(w, chars[w.stop] - chars[w.start], w.doc),
        "n_symbols": symbols[w.end] - symbols[w.begin],
        "n_dup_lines": np.bincount(line_doc[twice], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n).astype(np.int64),
        "n_lines": np.bincount(line_doc, minlength=n).astype(np.int64),
        "n_upper": uppers[w.end] - uppers[w.begin],
        "n_letters": letters[w.end] - letters[w.begin],
        "n_shouts": np.bincount(w.doc[shout], minlength=n).astype(np.int64),
        "n_distinct": np.bincount(w.doc[~_equal_before(w.doc, w.hashes)], minlength=n).astype(np.int64),
        "n_plain": np.bincount(w.doc[plain], minlength=n).astype(np.int64),
        "n_bare": np.bincount(w.doc[bare], minlength=n).astype(np.int64),
        "n_ends": np.bincount(w.doc[mark], minlength=n).astype(np.int64),
    }


def with_measures(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the measures of ``text`` to all columns, their names behind ``prefix``."""
    at = [c.lower() for c in docs.columns].index(text.lower())
    names = [f"{prefix}{m.split()[0]}" for m in MEASURES.split(", ")]
    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for batch in batches:
            for rows, part in text_slices(batch, at):
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, measure(part).values())], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def _bad(value, when) -> F.Column:
    return F.when(when(value), 0).otherwise(1)


def votes(prefix: str = "") -> dict[str, F.Column]:
    """0: bad, 1: no vote, 2: good, for each rule.

    That a text is free of one fault says little: most rules speak against a text or not at all.
    """

    def col(name: str) -> F.Column:
        return F.col(prefix + name)

    def ratio(a: str, b: str) -> F.Column:
        return col(a) / F.greatest(col(b), F.lit(1))

    ends, plain = ratio("n_ends", "n_words"), ratio("n_plain", "n_words")
    return {
        "symbols": _bad(ratio("n_symbols", "word_chars"), lambda v: v > 0.06),
        "letters": _bad(ratio("n_letters", "word_chars"), lambda v: v < 0.75),
        "bare_words": _bad(ratio("n_bare", "n_words"), lambda v: v > 0.2),
        "upper": _bad(ratio("n_upper", "n_letters"), lambda v: v > 0.4),
        "shouts": _bad(ratio("n_shouts", "n_words"), lambda v: v > 0.2),
        "lines": _bad(ratio("n_dup_lines", "n_lines"), lambda v: (v > 0.3) & (col("n_dup_lines") > 2)),
        "repeats": _bad(ratio("n_repeat_words", "n_words"), lambda v: v > 0.3),
        "variety": _bad(ratio("n_distinct", "n_words"), lambda v: (v < 0.15) & col("n_words").between(50, 2000)),
        "plain_words": _bad(plain, lambda v: v < 0.6),
        "prose": F.when((plain > 0.85) & ends.between(0.03, 0.35), 2).otherwise(1),
    }


def vote_pattern(prefix: str = "") -> F.Column:
    """The votes of all rules as one number."""
    return sum((v * 3**i for i, v in enumerate(votes(prefix).values())), F.lit(0))


def base_failed(prefix: str = "") -> F.Column:
    """Under 20 words, or over 30 % of the words in repeated windows of 8."""
    words = F.col(f"{prefix}n_words")
    return (words < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * words)


#: Before any data a vote is taken for this much evidence (log-odds of 0.85), with the weight of this
#: share of all documents. The share of good documents is given, since silent rules cannot tell it, so a
#: text that no rule speaks against is good. Evidence stays in the bounds and keeps its side.
EVIDENCE, PRIOR_SHARE, GOOD_SHARE, BOUNDS = 1.73, 0.02, 0.8, (0.3, 4.0)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of good for each pattern (rows of votes, with counts).

    Each rule casts either vote at a rate of its own among good and among bad documents; the ratio of
    the two is the vote's evidence. A rule's silence says nothing.
    """
    if not len(counts):
        return np.zeros(0)
    n = counts.sum()
    cast = np.stack([patterns == 0, patterns == 2]).astype(float)  # vote, pattern, rule
    seen = np.einsum("p,vpr->vr", counts, cast) / n
    evidence = np.full(seen.shape, EVIDENCE) * [[-1], [1]]
    # rates that stand for the evidence before any data
    before = np.stack([seen / (1 + np.exp(evidence)), seen / (1 + np.exp(-evidence))]) * 2  # class, vote, rule
    given, posterior = np.log(GOOD_SHARE / (1 - GOOD_SHARE)), np.full(len(counts), GOOD_SHARE)
    for _ in range(rounds):
        fresh = 1 / (1 + np.exp(-np.clip(given + np.einsum("vpr,vr->p", cast, evidence), -500, 500)))
        done = np.abs(fresh - posterior).max() < 1e-9
        posterior = fresh
        if done:
            break
        held = np.stack([(1 - posterior) * counts, posterior * counts])
        rate = (np.einsum("cp,vpr->cvr", held, cast) + PRIOR_SHARE * n * before + 1e-9) / (held.sum(axis=1) + PRIOR_SHARE * n)[:, None, None]
        evidence = np.log(rate[1] / rate[0])
        evidence = np.stack([np.clip(evidence[0], -BOUNDS[1], -BOUNDS[0]), np.clip(evidence[1], *BOUNDS)])
    return posterior


def fit_quality(measured: DataFrame) -> DataFrame:
    """(pattern, quality): the posterior of good of every vote pattern that occurs, at most 3 ** rules rows."""
    seen = sorted(map(tuple, measured.select(vote_pattern().alias("pattern")).groupBy("pattern").count().collect()))
    codes = np.array([p for p, _ in seen], np.int64)
    good = fit_votes(codes[:, None] // 3 ** np.arange(len(votes())) % 3, np.array([c for _, c in seen], float))
    return measured.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(codes, good, strict=True)], "pattern int, quality double")


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """For every row: doc_id, the measures, base_failed, quality (posterior of good), kept.

    ``kept`` is false where the base rules fail, else whether ``quality`` reaches ``least``. Null texts are
    empty and fail; repeated rows are judged alike; an empty table gives no rows. All rows take part in
    the estimate.
    """
    measured = checkpointed(with_measures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    known = fit_quality(measured)
    return (
        measured.withColumn("pattern", vote_pattern()).join(F.broadcast(known), "pattern").withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop("pattern")
    )


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are. Texts are measured twice, once for the
    estimate and once for the choice, and never shuffled."""
    known = fit_quality(checkpointed(with_measures(docs.select(F.col(text).alias("text"))).drop("text")))
    good = known.filter(F.col("quality") >= least).select(F.col("pattern").alias("_quality_pattern"))
    measured = with_measures(docs, text, "_quality_").withColumn("_quality_pattern", vote_pattern("_quality_"))
    return measured.filter(~base_failed("_quality_")).join(F.broadcast(good), "_quality_pattern", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
