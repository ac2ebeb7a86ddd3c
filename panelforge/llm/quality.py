"""Line-by-line quality from a linear-chain conditional random field.

Every line of a document is a place of the chain. Its features describe the line (length, shares of character kinds,
repetition, separators) and, as copies, its two neighbours. Line labels start as the document's label; then the
field's own marginals relabel good lines inside bad documents once, and the field is fitted again. A document's
quality is a logistic function of its length-weighted marginals.

Defined results: null or empty text is one empty line; repeated rows score alike; with no labelled rows of both kinds
every score is the share of good labels (1 without labels, so that a filter keeps all); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import crf
from panelforge.llm.common import held_out, only, slices, table, tidy, utf8
from panelforge.llm.labelled import training_rows

ROUNDS = 150
THRESHOLD = 0.5

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:'\"-()?"
_BARS = b"|"
_LOUD = b"!"
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGITS + _PLAIN + _BARS + _LOUD)
_KINDS = (_UPPER, _LOWER, _DIGITS, _SPACE, _PLAIN, _BARS, _LOUD, _SYMBOLS)
WIDTH = 14
SCHEMA = "doc_id long, score double, n_lines long, bad_share double, lines array<double>"


def line_features(line: bytes) -> list[float]:
    """Fourteen numbers near [0, 1]."""
    n = len(line) or 1
    upper, lower, digits, space, plain, bars, loud, symbols = (len(line) - len(line.translate(None, kind)) for kind in _KINDS)
    words = line.split()
    k = len(words) or 1
    again = sum(map(eq, words, words[1:]))
    letters = upper + lower or 1
    return [
        min(upper / letters, 1.0), digits / n, plain / n * 5, min(bars / k, 1.0), min(loud / k, 1.0), min(symbols / k, 3.0) / 3,
        again / k, len(set(words)) / k, min(np.log1p(n) / 8, 1.0), min(n / k / 12, 2.0), float(not words),
        float(bars > 1), float(symbols > k), float(k < 4),
    ]


def _lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def design(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with their neighbours' (zero beyond the ends), lines per text, and bytes per line."""
    own, lengths, sizes = [], [], []
    for text in texts:
        lines = _lines(text)
        lengths.append(len(lines))
        for line in lines:
            own.append(line_features(line))
            sizes.append(len(line) + 1)
    x = np.array(own).reshape(-1, WIDTH)
    lengths = np.array(lengths, np.int64)
    ends = np.cumsum(lengths)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:] = x[:-1]
    after[:-1] = x[1:]
    before[ends - lengths] = 0
    after[ends - 1] = 0
    return np.hstack([x, before, after, np.ones((len(x), 1))]), lengths, np.array(sizes, np.float64)


def aggregate(p: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of bad lines per document."""
    ends = np.cumsum(lengths)
    bad, whole = np.concatenate([[0.0], np.cumsum(p * sizes)]), np.concatenate([[0.0], np.cumsum(sizes)])
    return (bad[ends] - bad[ends - lengths]) / (whole[ends] - whole[ends - lengths])


@dataclass(frozen=True)
class QualityModel:
    """State 1 of the field is a bad line; beta gives the probability that a document is good."""

    weights: np.ndarray
    move: np.ndarray
    beta: np.ndarray
    constant: float | None = None

    def line_marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return crf.marginals(x @ self.weights, lengths, self.move)

    def document_scores(self, bad: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bad), self.constant)
        return crf.sigmoid(bad * self.beta[0] + self.beta[1])


def fit(texts: list[str], good: list[int], share: dict[int, float]) -> QualityModel:
    total = sum(share.get(v, 0) * good.count(v) for v in (0, 1))
    if len(set(good)) < 2:
        rate = share.get(1, 0) * good.count(1) / total if total else 1.0
        return QualityModel(np.zeros(3 * WIDTH + 1), np.zeros((2, 2)), np.zeros(2), rate)
    x, lengths, sizes = design([t.encode() for t in texts])
    bad = np.repeat(1 - np.array(good), lengths)
    labels = bad.copy()
    for _ in range(2):
        weights, move = crf.fit(lambda w: x @ w, lambda r: x.T @ r, x.shape[1], labels, lengths, ROUNDS, 0.3, 1e-7)
        p = crf.marginals(x @ weights, lengths, move)
        labels = bad * (p > 0.5)
    mean = aggregate(p, lengths, sizes)
    beta = crf.logistic(mean[:, None], np.array(good), np.array([share[v] for v in good]), decay=0.05)
    return QualityModel(weights, move, beta)


def learn(documents: DataFrame, labels: DataFrame) -> QualityModel:
    return fit(*training_rows(documents, labels, "quality"))


def _score(texts: list[bytes], model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, lengths, sizes = design(texts)
    p = model.line_marginals(x, lengths)
    bad = aggregate(p, lengths, sizes)
    return model.document_scores(bad), bad, lengths, p


def score_documents(documents: DataFrame, model: QualityModel) -> DataFrame:
    """Per document its score, the number of lines, the bad share, and every line's marginal: see SCHEMA."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score, bad, lengths, p = _score(utf8(batch.column("text")), shared.value)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(lengths), pa.array(bad), pa.ListArray.from_arrays(offsets, pa.array(p))],
                ["doc_id", "score", "n_lines", "bad_share", "lines"],
            )

    return only(documents, "doc_id", "text").mapInArrow(tidy(rows), SCHEMA)


def good_documents(documents: DataFrame, model: QualityModel, least: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            score = _score(utf8(batch.column("text")), shared.value)[0]
            yield batch.filter(pa.array(score >= least))

    return documents.mapInArrow(tidy(rows), documents.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(documents, learn(documents, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "bad_share"
    )
