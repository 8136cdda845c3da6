"""Quality rules: counts of words, symbols, repeated lines and windows, and a calibrated logistic regression.

The model works on frequencies of hashed word and character n-grams, learns from labelled quality rows, is calibrated on
rows it did not learn from, and scores in Arrow batches against a fixed threshold.
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

BITS = 15  # of each family
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 4)
FAMILIES = len(WORD_GRAMS) + len(CHAR_GRAMS)
SAMPLE_ROWS = 3000
SCALE = 30.0
PENALTY = 1e-6
STEPS = 80
RATE = 0.3
CALIBRATION_PART = 5
ROWS_AT_ONCE = 250

KEEP_FROM = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
RULES_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"
)


def slots(hashes: np.ndarray, family: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64) + (family << BITS)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, slot, document) of every n-gram, in parts."""
    words = ft.words_of(data, offsets, lower=True)
    for family, n in enumerate(WORD_GRAMS):
        h, doc = ft.ngrams(words.hashes, words.doc, n, family)
        yield family, slots(h, family), doc
    for family, n in enumerate(CHAR_GRAMS, len(WORD_GRAMS)):
        for h, doc in ft.char_ngrams(data, offsets, n, family):
            yield family, slots(h, family), doc


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margins(self, rows: int, parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        total, count = np.zeros((FAMILIES, rows)), np.zeros((FAMILIES, rows))
        for family, slot, doc in parts:
            total[family] += np.bincount(doc, self.weight[slot], rows)
            count[family] += np.bincount(doc, minlength=rows)
        return SCALE * (total / np.maximum(count, 1)).sum(axis=0) + self.bias

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margins + self.b, -500, 500)))


def frequencies(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of one document and their shares of its family's n-grams."""
    total: dict[int, list[np.ndarray]] = {}
    for family, slot, _ in parts:
        total.setdefault(family, []).append(slot)
    slot, share = [], []
    for found in total.values():
        s, n = np.unique(np.concatenate(found), return_counts=True)
        slot.append(s)
        share.append(n / max(n.sum(), 1))
    return np.concatenate(slot), np.concatenate(share)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """Logistic regression with a step size per weight (AdaGrad on the whole sample); both classes weigh the same.

    ``rows`` is used up: what the model learns from is taken out of the list.

    Labels of one class only, or none, give a model that scores every text with their rate (0.5 without labels).
    """
    weight = np.zeros(FAMILIES << BITS)
    if len(y) == 0 or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(weight.astype(np.float32), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    apart = np.arange(len(y)) % CALIBRATION_PART == 0
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    learn = np.flatnonzero(~apart)
    ones = float(y[learn].sum())
    parts = []
    for at in range(0, len(learn), ROWS_AT_ONCE):
        part = learn[at : at + ROWS_AT_ONCE]
        target = y[part].astype(float)
        parts.append((
            np.concatenate([rows[i][0] for i in part]),
            np.concatenate([rows[i][1] for i in part]).astype(np.float32) * np.float32(SCALE),
            np.repeat(np.arange(len(part), dtype=np.int32), [len(rows[i][0]) for i in part]),
            target,
            1 / (2 * np.where(target == 1, ones, len(learn) - ones)),
        ))
        if apart.any():
            for i in part:
                rows[i] = None  # they stand in the part now
    bias, squares, bias_squares = 0.0, np.full(len(weight), 1e-12), 1e-12
    for _ in range(STEPS):
        slope, bias_slope = PENALTY * weight, 0.0
        for slot, value, row, target, cost in parts:
            z = np.bincount(row, weight[slot] * value, len(target)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target) * cost
            slope += np.bincount(slot, error[row] * value, len(weight))
            bias_slope += error.sum()
        squares += slope * slope
        weight -= RATE * slope / np.sqrt(squares)
        bias_squares += bias_slope**2
        bias -= RATE * bias_slope / np.sqrt(bias_squares)
    model = Model(weight.astype(np.float32), bias, 1.0, 0.0)
    check = np.flatnonzero(apart) if apart.any() else learn
    margins = np.array([SCALE * float(np.dot(weight[rows[i][0]], rows[i][1])) + bias for i in check])
    model.a, model.b = platt(margins, y[check])
    return model


def train(documents: DataFrame, labels: DataFrame, label_column: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out fold; executors make their n-grams."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ft.string_bytes(batch.column(2))
            for i in range(batch.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                slot, share = frequencies(grams(data[a:b], np.array([0, b - a])))
                cells = [[slot.astype("<i4").tobytes()], [share.astype("<f4").tobytes()]]
                part = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, pa.binary()) for c in cells)], ["id", "y", "slot", "share"]
                )

    sample = labelled_sample(documents, labels, label_column, sample_rows).select("id", "y", "text")
    got = sample.mapInArrow(extract, "id long, y int, slot binary, share binary").collect()
    got.sort(key=lambda r: (r.id * 2654435761 % (1 << 32), r.id))
    y = np.array([r.y for r in got], np.int64)
    rows = [(np.frombuffer(r.slot, "<i4"), np.frombuffer(r.share, "<f4")) for r in got]
    del got
    return fit(rows, y)


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a run."""
    rows = len(offsets) - 1
    words = ft.words_of(data, offsets)
    whole = lambda doc, weights=None: np.bincount(doc, weights, rows).astype(np.int64)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SYMBOL[data], out=symbols[1:])
    lines = ft.words_of(data, offsets, separator=ft.NEWLINE)
    told = lines.kinds != 0
    line_keys = ft.mixed(lines.hashes[told] + lines.doc[told].astype(np.uint64) * ft.BASE)
    _, first = np.unique(line_keys, return_index=True)
    window, _ = ft.ngrams(words.hashes, words.doc, 3, 0)
    at = np.flatnonzero(words.doc[2:] == words.doc[:-2])
    doubled = at[repeats(ft.mixed(window + words.doc[at].astype(np.uint64) * ft.BASE))]
    covered = np.zeros(len(words.doc), bool)
    for i in range(3):
        covered[doubled + i] = True
    return [
        whole(words.doc), whole(words.doc, words.chars), symbols[offsets[1:]] - symbols[offsets[:-1]],
        whole(lines.doc[told]) - whole(lines.doc[told][first]), whole(words.doc[covered]),
    ]


def rule_counts(model: Model, text: Column) -> Column:
    """A struct of the base counts and the model's probability for each text; null is empty: no words, no symbols."""

    @F.arrow_udf(RULES_DDL)
    def count(column: pa.Array) -> pa.Array:
        data, offsets = ft.string_bytes(column)
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for first, last in ft.runs(offsets):
            at = offsets[first : last + 1]
            part, at = data[at[0] : at[-1]], at - at[0]
            columns = [*base_counts(part, at), model.probabilities(model.margins(last - first, grams(part, at)))]
            for to, x in zip(out, columns, strict=True):
                to.append(x)
        names = [x.split(" ")[0] for x in RULES_DDL.split(", ")]
        arrays = [pa.array(np.concatenate(x) if x else [], pa.float64() if n == "probability" else pa.int64()) for n, x in zip(names, out, strict=True)]
        return pa.StructArray.from_arrays(arrays, names)

    return count(F.coalesce(text, F.lit("")))


def with_rules(df: DataFrame, model: Model, text_column: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept.

    ``base_failed``: fewer than 50 words, or more than half of the words in three-word windows found twice. ``kept``: the base rules hold and the
    probability is at least ``keep_from``. Columns of ``df`` with these names are replaced; rows stay one to one.
    """
    from invoiceloom.llm.rows import packed, unpacked

    counted = df.select(packed(df)).withColumn("rule", rule_counts(model, F.col("row")[text_column]))
    rule = F.col("rule")
    failed = (rule["n_words"] < MIN_WORDS) | (100 * rule["n_repeat_words"] > MAX_REPEAT_PERCENT * rule["n_words"])
    counts = {n: rule[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    verdict = {"base_failed": failed, "probability": rule["probability"], "kept": ~failed & (rule["probability"] >= keep_from)}
    return unpacked(counted, df.columns, counts | verdict)
