"""Toxicity by weak supervision.

Voters are a short lexicon, patterns, and words and word beginnings that the labelled rows bring up. Each
fires on a text or stays silent. A generative model estimates how often a voter fires on toxic and on
clean texts, with voters that fire together counted as one vote; a linear classifier is then trained
on its posterior labels and scores all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logweave.llm.stretches import text_slices
from logweave.llm.words import worker_state
from logweave.session import checkpointed

#: Labelled rows that the model is fitted on, the first by a hash of their id; everything is scored.
MAX_LABELLED = 20_000
#: Toxic texts that a voter must occur in.
LEAST_TEXTS = 3
#: Log-likelihood ratio below which a voter may well be chance among some hundred thousand candidates.
LEAST_RATIO = 18.0
#: How many times as often a voter must occur in toxic texts as in clean ones.
TIMES = 20
#: Lengths of word beginnings that can become voters.
BEGINNINGS = (4, 5, 6, 7)
#: How many different words with a beginning a voter may ask for.
AGAIN = (1, 2, 3)
#: Voters whose firing is correlated above this are one vote.
SAME_VOTE = 0.7
#: How often a given label is taken to be right.
LABEL_RIGHT = 0.995

# Common insults
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown", "dumb", "garbage", "imbecile", "vermin")
PATTERNS = (
    r"\byou(?:'re| are) (?:a|an|so|such|nothing)\b",
    r"\b(?:shut up|get lost|drop dead|go to hell)\b",
    r"\b(?:hate|despise) (?:you|them|those)\b",
)

WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    words: dict[str, int]  # voter of a whole word
    begins: dict[str, list[tuple[int, int]]]  # beginning: (different words that it takes, voter)
    patterns: dict[str, int]
    weights: np.ndarray  # one for each voter
    bias: float


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _features(words: set[str]) -> list[str]:
    """``=word``, and ``k~beginning`` for a beginning that k different words or more have."""
    begins: Counter[str] = Counter()
    for n in BEGINNINGS:
        begins.update(w[:n] for w in words if len(w) > n)
    return [f"={w}" for w in words] + [f"{k}~{b}" for b, c in begins.items() for k in AGAIN if k <= c]


def _counted(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): the labelled texts it occurs in, counted in each batch before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for part, texts in text_slices(batch, 0):
                for text, toxic in zip(texts, part.column(1).to_pylist(), strict=True):
                    for f in _features(set(WORD.findall(text.decode().lower()))):
                        counts.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            # a feature of clean texts alone can become no voter
            names = [f for f, c in counts.items() if c[0]] + [f for f, c in counts.items() if not c[0]]
            yield pa.RecordBatch.from_pydict({"feature": names, "toxic": [counts[f][0] for f in names], "clean": [counts[f][1] for f in names]})

    parts = sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_voters(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """Features that tell toxic texts, the best by the log-likelihood ratio of their counts."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    all_ = toxic + clean

    def part(seen: F.Column, expected: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = part(a, (a + b) * toxic / all_) + part(b, (a + b) * clean / all_)
    ratio += part(toxic - a, (all_ - a - b) * toxic / all_) + part(clean - b, (all_ - a - b) * clean / all_)
    best = (
        _counted(sample).filter((F.col("toxic") >= LEAST_TEXTS) & (a / toxic > TIMES * (b + 0.5) / (clean + 1)))
        .withColumn("ratio", 2 * ratio).filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "feature")
    )
    # every feature above the ratio, which is far fewer than the words of the labelled rows
    return [r["feature"] for r in best.select("feature").collect()]


def _voters(found: list[str]) -> tuple[dict[str, int], dict[str, list[tuple[int, int]]], dict[str, int], int]:
    words = {w: i for i, w in enumerate(dict.fromkeys([f[1:] for f in found if f[0] == "="] + list(LEXICON)))}
    begins: dict[str, list[tuple[int, int]]] = {}
    for i, f in enumerate((f for f in found if f[0] != "="), len(words)):
        times, begin = f.split("~", 1)
        begins.setdefault(begin, []).append((int(times), i))
    n = len(words) + sum(map(len, begins.values()))
    return words, begins, {p: n + i for i, p in enumerate(PATTERNS)}, n + len(PATTERNS)


class Firing:
    """Voters that fire on a text; words without a voter are remembered."""

    def __init__(self, model: Model, memory: dict):
        self.model, self.hot, self.cold = model, memory.setdefault("hot", {}), memory.setdefault("cold", set())
        self.lengths = sorted({len(b) for b in model.begins})
        self.patterns = [(re.compile(p), v) for p, v in model.patterns.items()]
        self.memory = memory

    def of(self, text: str) -> set[int]:
        low = text.lower()
        words = set(WORD.findall(low))
        if len(self.cold) > 300_000 or len(self.hot) > 300_000:
            self.cold.clear()
            self.hot.clear()
        for w in words.difference(self.cold):
            if w not in self.hot:
                begins = [w[:n] for n in self.lengths if len(w) > n and w[:n] in self.model.begins]
                if begins or w in self.model.words:
                    self.hot[w] = (self.model.words.get(w), begins)
                else:
                    self.cold.add(w)
        out, counts = set(), Counter()
        for w in words.intersection(self.hot):
            voter, begins = self.hot[w]
            counts.update(begins)
            if voter is not None:
                out.add(voter)
        out.update(v for b, c in counts.items() for times, v in self.model.begins[b] if c >= times)
        return out | {v for p, v in self.patterns if p.search(low)}


class Fired(NamedTuple):
    """Which voters fire on which texts, as pairs."""

    text: np.ndarray
    voter: np.ndarray
    texts: int
    voters: int

    @classmethod
    def of(cls, lists: list, voters: int) -> Fired:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return cls(np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64), len(lists), voters)

    def by_text(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights[self.voter], self.texts)

    def by_voter(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.voter, weights[self.text], self.voters)

    def groups(self) -> np.ndarray:
        """How many voters fire together with each, itself included: those correlated above SAME_VOTE."""
        both = np.zeros((self.voters, self.voters), np.float32)
        for low in range(0, self.texts, 1024):
            inside = (self.text >= low) & (self.text < low + 1024)
            part = np.zeros((1024, self.voters), np.float32)
            part[self.text[inside] - low, self.voter[inside]] = 1
            both += part.T @ part
        share = np.diag(both).astype(float) / self.texts
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
        return np.array([max(1, int(((both[v] / self.texts - share[v] * share) > SAME_VOTE * spread[v] * spread).sum())) for v in range(self.voters)])


def fit_votes(fired: Fired, toxic: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxic for each text, and the evidence of each voter, from votes and a given label, itself one noisy vote.

    Rates of firing are estimated for both classes; silence says nothing, as most voters know one
    language only. A voter's evidence is divided by the number of voters that it fires together with,
    its correlated group.
    """
    group = fired.groups()
    posterior = np.where(toxic, 0.95, 0.05)
    for _ in range(rounds):
        weights = np.stack([1 - posterior, posterior])
        # half a firing besides, so that no rate is 0
        rate = (np.stack([fired.by_voter(w) for w in weights]) + 0.5 * np.array([[toxic.mean() / 4], [1]])) / (weights.sum(axis=1, keepdims=True) + 1)
        rate = np.clip(rate, 1e-6, 1 - 1e-6)
        share = np.clip(posterior.mean(), 1e-4, 0.5)
        each = (np.log(rate[1]) - np.log(rate[0])) / group
        label = np.where(toxic, np.log(LABEL_RIGHT / (1 - LABEL_RIGHT)), np.log((1 - LABEL_RIGHT) / LABEL_RIGHT))
        fresh = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + fired.by_text(each) + label, -50, 50)))
        done = np.abs(fresh - posterior).max() < 1e-6
        posterior = fresh
        if done:
            break
    return posterior, each


def fit_linear(fired: Fired, target: np.ndarray, start: np.ndarray, decay: float = 0.005, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with momentum; both classes weigh the same
    half, and weights are not negative: no voter speaks for a clean text. ``start`` is the evidence of the
    generative model, from which the steps set out."""
    balance = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    weights, bias = np.clip(start, 0, 8), -3.0
    speed, drift = np.zeros(fired.voters), 0.0
    for _ in range(rounds):
        wrong = balance * (1 / (1 + np.exp(-np.clip(fired.by_text(weights) + bias, -50, 50))) - target)
        speed = 0.9 * speed - (fired.by_voter(wrong) + decay * weights / len(weights))
        drift = 0.9 * drift - wrong.sum()
        weights = np.maximum(weights + 2 * speed, 0)
        bias += 2 * drift
    return weights, float(bias)


#: Without labelled rows of both kinds: what a lexicon word and a pattern weigh, and the bias.
PLAIN_WORD, PLAIN_PATTERN, PLAIN_BIAS = 5.0, 2.0, -4.0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Train on the labelled rows that are not held out, at most ``max_labelled``, the first by a hash of
    their id. ``docs`` has doc_id and text, ``labels`` doc_id and toxic (0 or 1; null is no label; of
    several labels of one id the largest holds, of several texts the one of the smallest hash). Labels of ids that
    ``docs`` does not have count for nothing. Without toxic and clean rows the lexicon alone decides."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), "toxic").filter("toxic is not null and label_id is not null").groupBy("label_id").agg(F.max("toxic").alias("label"))
    known = checkpointed(known.filter(~held_out("label_id")))
    met = texts.select("doc_id", "text_hash").join(known, F.col("doc_id") == F.col("label_id")).groupBy("label_id", "label").agg(F.min("text_hash").alias("label_hash"))
    chosen = checkpointed(met.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled))
    # the bound on labelled rows bounds the broadcast: no text is shuffled but theirs
    sample = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("label_id")) & (F.col("text_hash") == F.col("label_hash"))).dropDuplicates(["doc_id"])
    # copies of one text are one piece of evidence
    sample = sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    sample = checkpointed(sample.select("doc_id", "text", (F.col("label") == 1).alias("toxic")))
    counts = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = counts.get(True, 0), counts.get(False, 0)
    if not toxic or not clean:
        words, begins, patterns, _ = _voters([])
        return Model(words, begins, patterns, np.array([PLAIN_WORD] * len(words) + [PLAIN_PATTERN] * len(patterns)), PLAIN_BIAS)
    words, begins, patterns, n = _voters(choose_voters(sample, toxic, clean))
    empty = Model(words, begins, patterns, np.zeros(0), 0.0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firing = Firing(empty, {})
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                fired = pa.array([sorted(firing.of(t.decode())) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), fired], names=["doc_id", "toxic", "fired"])

    rows = sample.mapInArrow(run, "doc_id long, toxic boolean, fired array<int>").toPandas().sort_values(["doc_id", "toxic"])  # bounded by max_labelled
    fired = Fired.of(list(rows["fired"]), n)
    posterior, evidence = fit_votes(fired, rows["toxic"].to_numpy(bool))
    weights, bias = fit_linear(fired, posterior, evidence)
    return Model(words, begins, patterns, weights, bias)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) of every row; null and empty texts score as texts on which no voter fires.

    A null id counts as empty text where rows are held out; repeated rows score alike; an empty table gives none."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = source.select("doc_id", held_out().alias("held_out"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        mark = (tuple(model.words), tuple(model.begins), float(model.weights.sum()), model.bias)
        if state.get("mark") != mark:
            state.clear()
            state["mark"] = mark
        firing = Firing(model, state)
        for batch in batches:
            for part, texts in text_slices(batch, 2):
                sums = [model.bias + sum(model.weights[v] for v in firing.of(t.decode())) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(np.array(sums, float), -50, 50))))], names=["doc_id", "held_out", "score"]
                )

    return keyed.mapInArrow(run, "doc_id long, held_out boolean, score double")
