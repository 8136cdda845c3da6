"""Quality scores from a support vector machine on Naive Bayes features.

Indicators of word n-grams, and of n-grams of word patterns (kinds of characters, distance to the same word before), are
scaled by the log-ratio of their counts in the two classes; a linear hinge-loss model is then fitted by dual coordinate
descent and its margins are turned into probabilities on rows it did not learn from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm import features as ft
from invoiceloom.llm.labelled import labelled_sample, platt

BITS = 18
SAMPLE_ROWS = 6000
THRESHOLD = 0.7
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
CALIBRATION_PART = 5


def run_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, document) of a run, sorted by document."""
    words = ft.words_of(data, offsets, lower=True)
    pattern = words.kinds.astype(np.uint64) * np.uint64(4) + ft.back_distance(words)
    families = [(words.hashes, 1, 1), (words.hashes, 2, 2), (pattern, 1, 3), (pattern, 2, 4), (pattern, 3, 5), (pattern, 5, 6)]
    found = [ft.ngrams(codes, words.doc, n, family) for codes, n, family in families]
    return ft.distinct(np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found]), BITS)


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of a column: (first row, rows, features, rows of the features counted from the first)."""
    data, offsets = ft.string_bytes(column)
    for first, last in ft.runs(offsets):
        at = offsets[first : last + 1]
        feature, doc = run_features(data[at[0] : at[-1]], at - at[0])
        yield first, last - first, feature, doc


@dataclass
class Model:
    """Weight and scale per feature, bias, and the two numbers that turn a margin into a probability."""

    weight: np.ndarray
    scale: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, rows: int, feature: np.ndarray, doc: np.ndarray) -> np.ndarray:
        scale = self.scale[feature]
        length = np.sqrt(np.bincount(doc, scale * scale, rows))
        total = np.bincount(doc, self.weight[feature] * scale, rows)
        return total / np.maximum(length, 1e-12) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -500, 500)))


def constant(rate: float) -> Model:
    """The model where labels of both classes are missing: every text scores ``rate``."""
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(rate / (1 - rate))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {c: np.full(1 << BITS, SMOOTHING) for c in (0, 1)}
    for feature, label in zip(rows, y, strict=True):
        counts[int(label)][feature] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss with a squared penalty; both classes weigh the same in the loss."""
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum()))
    values = []
    for feature in rows:
        v = scale[feature]
        values.append(v / max(float(np.sqrt(np.dot(v, v))), 1e-12))
    norms = np.array([float(np.dot(v, v)) for v in values]) + 1.0  # the last one is the bias
    weight, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            gradient = sign[i] * (float(np.dot(weight[rows[i]], values[i])) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                weight[rows[i]] += change * values[i]
                bias += change
                alpha[i] = new
    return weight, bias


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of labelled feature rows; a part of them is left for calibration."""
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    apart = np.arange(len(y)) % CALIBRATION_PART == 0
    learn = [r for r, out in zip(rows, apart, strict=True) if not out]
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        learn, apart = rows, np.zeros(len(y), bool)
    y_learn = y[~apart]
    scale = log_count_ratio(learn, y_learn)
    weight, bias = dual_coordinate_descent(learn, y_learn, scale)
    model = Model(weight.astype(np.float32), scale.astype(np.float32), bias, 1.0, 0.0)
    check = [i for i in range(len(y)) if apart[i]] or list(range(len(y)))
    margins = np.array([model.margins(1, rows[i], np.zeros(len(rows[i]), np.int64))[0] for i in check])
    model.a, model.b = platt(margins, y[check])
    return model


def train(documents: DataFrame, labels: DataFrame, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold; see :func:`labelled_sample`.

    Their features are made by the executors; the driver sees a row of numbers for each.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, feature, doc in text_features(batch.column(2)):
                borders = np.searchsorted(doc, np.arange(n + 1))
                cells = [feature[borders[i] : borders[i + 1]].astype("<i4").tobytes() for i in range(n)]
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.binary())], ["id", "y", "feature"])

    sample = labelled_sample(documents, labels, label_column, sample_rows).select("id", "y", "text")
    got = sorted(sample.mapInArrow(extract, "id long, y int, feature binary").collect(), key=lambda r: (r.id * 2654435761 % (1 << 32), r.id))
    return fit([np.frombuffer(r.feature, "<i4") for r in got], np.array([r.y for r in got], np.int64))


def quality_score(model: Model, text: Column) -> Column:
    """Score of every text, 0 to 1; null and empty texts score as a text without features."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for first, n, feature, doc in text_features(column):
            out[first : first + n] = model.scores(model.margins(n, feature, doc))
        return pa.array(out)

    return score(F.coalesce(text, F.lit("")))
