"""Toxic spans and document scores from a linear-chain conditional random field over words.

Fitting (on the driver, on the bounded sample of labelled.py): document labels become word labels. A word of a toxic
document is toxic if the word or one of its prefixes occurs in enough different neighbourhoods of toxic documents and
hardly ever in clean ones; neighbourhoods, not occurrences, are counted, so copies of one document prove nothing. The
field then learns weights of words and prefixes and the moves between states from these labelled tokens, and a small
logistic regression turns the forward-backward marginals of a document into its probability.

Scoring: each word has one emission score, so a document is a lookup per word and one pass each way.

Defined results: null or empty text and text without letters have no words and get the score of a document whose
marginals are all zero; repeated rows score alike; with no labelled rows of both kinds every score is the share of
toxic labels (0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import crf
from panelforge.llm.common import held_out, only, slices, table, tidy
from panelforge.llm.labelled import training_rows

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
LEAST_SUPPORT = 5
LEAST_ODDS = 3.5
ROUNDS = 40
THRESHOLD = 0.7
CACHE_MOST = 300_000

SCHEMA = "doc_id long, score double, n_words long, spans array<struct<start:int,stop:int,marginal:double>>"


def features(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) >= k]]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class ToxicModel:
    weights: dict[str, float]
    bias: float
    move: np.ndarray
    beta: np.ndarray
    constant: float | None = None

    def word_score(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def document_scores(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(lengths), self.constant)
        x = np.column_stack([aggregate(p, lengths), np.ones(len(lengths))])
        return crf.sigmoid(x @ self.beta)


def aggregate(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: the log odds of the highest marginal (bounded), and how many marginals pass one half, as a log.
    Neither grows with the length of a clean document."""
    ends = np.cumsum(lengths)
    hits = np.concatenate([[0], np.cumsum(p > 0.5)])
    highest = np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        highest[full] = np.maximum.reduceat(p, (ends - lengths)[full])
    highest = np.clip(highest, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(highest / (1 - highest)), np.minimum(np.log1p(hits[ends] - hits[ends - lengths]), 3.0)])


def _neighbourhoods(docs: list[np.ndarray], found: list[list[int]]) -> np.ndarray:
    """For each feature, in how many different neighbourhoods (word before, word after) it occurs."""
    size = 1 + max((f for fs in found for f in fs), default=-1)
    total = np.zeros(size, np.int64)
    docs = [d.astype(np.int64) for d in docs if len(d)]
    if not docs:
        return total
    words = np.concatenate(docs)
    around = np.concatenate([np.append(-1, d[:-1]) << 32 | np.append(d[1:], -1) & 0xFFFFFFFF for d in docs])
    around = np.unique(around, return_inverse=True)[1]
    for place in range(1 + len(PREFIXES)):  # a feature stands at one place of features() only
        own = np.array([fs[place] if place < len(fs) else -1 for fs in found], np.int64)[words]
        total += np.bincount(np.unique(own[own >= 0] << 32 | around[own >= 0]) >> 32, minlength=size)
    return total


def _marks(docs: list[np.ndarray], toxic: list[int], found: list[list[int]], clean_weight: float = 1.0) -> set[int]:
    """The features that mark toxic words. docs: word numbers; found: the feature numbers of each word; clean_weight:
    how many times the rows a sampled clean document stands for exceed those of a toxic one."""
    there = _neighbourhoods([d for d, t in zip(docs, toxic, strict=True) if t], found)
    here = _neighbourhoods([d for d, t in zip(docs, toxic, strict=True) if not t], found) * clean_weight
    scale = min(math.log((sum(toxic) + 1) / ((len(toxic) - sum(toxic)) * clean_weight + 1)), 0)
    odds = np.log((there + 0.5) / (here + 0.5)) - scale
    return set(np.flatnonzero((there >= LEAST_SUPPORT) & (odds >= LEAST_ODDS) & (here * 20 <= there)).tolist())


def fit(texts: list[str], toxic: list[int], share: dict[int, float]) -> ToxicModel:
    total = sum(share.get(v, 0) * toxic.count(v) for v in (0, 1))
    if len(set(toxic)) < 2:
        rate = share.get(1, 0) * toxic.count(1) / total if total else 0.0
        return ToxicModel({}, 0.0, np.zeros((2, 2)), np.zeros(3), rate)
    ids: dict[str, int] = {}
    docs = [np.fromiter((ids.setdefault(w, len(ids)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
    names: dict[str, int] = {}
    found = [[names.setdefault(f, len(names)) for f in features(w)] for w in ids]
    marks = _marks(docs, toxic, found, share[0] / share[1])
    marked = np.array([any(f in marks for f in fs) for fs in found], np.int64)
    word_at = np.repeat(np.arange(len(found)), [len(fs) for fs in found])
    feature_at = np.fromiter((f for fs in found for f in fs), np.int64, len(word_at))
    lengths = np.array([len(d) for d in docs])
    tokens = np.concatenate(docs)
    labels = marked[tokens] * np.repeat(np.array(toxic), lengths)
    size = len(names) + 1

    def emit(w: np.ndarray) -> np.ndarray:
        return (np.bincount(word_at, w[feature_at], len(ids)) + w[-1])[tokens]

    def spread(r: np.ndarray) -> np.ndarray:
        by_word = np.bincount(tokens, r, len(ids))
        return np.append(np.bincount(feature_at, by_word[word_at], len(names)), r.sum())

    weights, move = crf.fit(emit, spread, size, labels, lengths, ROUNDS, 0.5, 1e-8)
    p = crf.marginals(emit(weights), lengths, move)
    beta = crf.logistic(aggregate(p, lengths), np.array(toxic), np.array([share[v] for v in toxic]), decay=0.05)
    kept = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 0.02}
    return ToxicModel(kept, float(weights[-1]), move, beta)


def learn(documents: DataFrame, labels: DataFrame) -> ToxicModel:
    return fit(*training_rows(documents, labels, "toxic"))


class _Scores(dict):
    """Word scores, each worked out once; emptied when it holds too many."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_MOST:
            self.clear()
        score = self[word] = self.model.word_score(word)
        return score


def score_documents(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """Per document its score and the spans (code points) whose marginal is over one half: see SCHEMA."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = _Scores(model)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            lengths = np.zeros(len(texts), np.int64)
            parts = []
            for i, t in enumerate(texts):
                words = words_of(t)
                lengths[i] = len(words)
                parts.append(np.fromiter(map(scores.__getitem__, words), np.float64, len(words)))
            p = crf.marginals(np.concatenate(parts), lengths, model.move)
            ends = np.cumsum(lengths)
            spans: list[list[dict]] = [[] for _ in texts]
            hits = np.flatnonzero(p > 0.5)
            for i in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
                own = p[ends[i] - lengths[i] : ends[i]]
                # lower() may change lengths, so offsets are those of the lowered text where it does
                places = [m.span() for m in WORD.finditer(texts[i].lower())]
                spans[i] = [{"start": places[k][0], "stop": places[k][1], "marginal": float(own[k])} for k in np.flatnonzero(own > 0.5)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(model.document_scores(p, lengths)), pa.array(lengths), pa.array(spans, kind)],
                ["doc_id", "score", "n_words", "spans"],
            )

    return only(documents, "doc_id", "text").mapInArrow(tidy(rows), SCHEMA)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(documents, learn(documents, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans"
    )
