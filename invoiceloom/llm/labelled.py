"""A bounded sample of labelled documents, and how well scores fit labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT_FOLD = 2


def held_out(doc_id) -> object:
    """Whether a document belongs to the fold that no model learns from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label_column: str, rows: int) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents outside the held-out fold.

    Ids come in the order of a hash, so the same ones are drawn on every run and whatever the order of rows. Labels other than 0 and 1 and ids
    whose labels disagree are left out. The drawn ids are at most ``rows`` and may be broadcast. Rows that repeat an id give one text, that of the
    least hash.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label_column).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
        .where(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .where("y = most")
        .drop("most")
    )
    there = known.join(documents.select(F.col("doc_id").alias("id")), "id", "left_semi")
    drawn = there.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    of_id = texts.join(F.broadcast(drawn), "id").groupBy("id")
    return of_id.agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))


def platt(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a * margin + b))) fits the labels; Newton steps on smoothed targets."""
    ones, zeros = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * margins + b) - target * (a * margins + b)))
    now = loss(a, b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([np.dot(p - target, margins), np.sum(p - target)])
        v = p * (1 - p)
        h = np.array([[np.dot(v, margins**2), np.dot(v, margins)], [np.dot(v, margins), v.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if now - loss(a, b) < 1e-9:
            break
        now = loss(a, b)
    return float(a), float(b)
