"""Ranked lexical search: item tiles times document tiles as dense float64 matrix products.

Only terms of the items count, so a document shrinks to the few numbers of its terms that items hold. Items stand in tiles, each with the compact
vocabulary of its own items, cut into blocks whose weights can't make a sum of 2**53; documents stand in tiles of
impacts. Their products are whole numbers below 2**53, exact in float64 in whatever order they are added; blocks are added as 64-bit integers. A tile
keeps an item's best documents with the ties at the border, and windows rank what the tiles kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoiceloom.llm.rows import UPPER, column, written

#: A term is a maximal match of this; A-Z are lower-cased first.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BEST = 20
ITEMS_AT_ONCE = 256
TERMS_AT_ONCE = 2048
DOCUMENTS_AT_ONCE = 512
ENTRIES_AT_ONCE = 500_000
SALTS = 64
SLICE_BYTES = 1 << 20

#: An impact is below this whatever a document holds.
IMPACT_LIMIT = 1_000_000
EXACT_SUM = 2**53
NO_ID = np.iinfo(np.int64).max

#: Bytes to bytes: A-Z lower-cased, what separates terms a space. Bytes of other characters are at least 0x80 and belong to terms.
FOLD = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else (b + 32 if chr(b).isupper() else 0x20) for b in range(256)
)


def term_counts(text: memoryview, known: dict[bytes, int]) -> tuple[int, Counter]:
    """How many terms a text has, and how often each known one occurs. Texts are taken in slices that end between terms."""
    total, found, at, size = 0, Counter(), 0, len(text)
    rest = b""
    while at < size:
        part = rest + bytes(text[at : at + SLICE_BYTES]).translate(FOLD)
        at += SLICE_BYTES
        rest = b""
        if at < size:
            end = part.rfind(b" ") + 1
            part, rest = part[:end], part[end:]
        terms = part.split()
        total += len(terms)
        found.update(terms)
        if len(found) > len(known) + 200_000:
            found = Counter({t: n for t, n in found.items() if t in known})
    if rest:
        total += 1
        found[rest] += 1
    return total, Counter({known[t]: n for t, n in found.items() if t in known})


def document_terms(documents: DataFrame, terms: list[str], id_column: str, text_column: str) -> DataFrame:
    """(id, n, terms, times) of every document that has a term: its length, and number and count of each item term in it."""
    known = {t.encode(): i for i, t in enumerate(terms)}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, ends, numbers, times = [], [], [0], [], []
            for i, cell in enumerate(batch.column(1)):
                raw = cell.as_buffer()
                n, found = term_counts(memoryview(raw), known) if raw is not None else (0, {})
                if n:
                    keep.append(i)
                    sizes.append(n)
                    numbers.extend(found)
                    times.extend(found.values())
                    ends.append(len(numbers))
            borders = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(borders, pa.array(numbers, pa.int32())), pa.ListArray.from_arrays(borders, pa.array(times, pa.int64()))],
                ["id", "n", "terms", "times"],
            )

    source = documents.select(column(id_column).cast("long").alias("id"), column(text_column).cast("binary").alias("text"))
    return source.mapInArrow(told, "id long, n long, terms array<int>, times array<long>")


@dataclass
class Tile:
    """Some items and the terms of theirs: ``blocks`` of (numbers of the terms, weights items x terms), ``single`` terms of too large a weight."""

    items: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]
    single: list[tuple[np.ndarray, np.ndarray]]


def tiles(items: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> list[Tile]:
    """Tiles of entries (item number, term number, weight), ordered by item. Weights count an item's repeats of a term."""
    out = []
    borders = np.searchsorted(items, np.arange(0, (items[-1] if len(items) else -1) + 1 + ITEMS_AT_ONCE, ITEMS_AT_ONCE))
    for first, last in zip(borders[:-1], borders[1:], strict=True):
        if first == last:
            continue
        own = np.unique(items[first:last])
        row = np.searchsorted(own, items[first:last])
        vocabulary, col = np.unique(terms[first:last], return_inverse=True)
        tile = Tile(own, [], [])
        for low in range(0, len(vocabulary), TERMS_AT_ONCE):
            inside = (col >= low) & (col < low + TERMS_AT_ONCE)
            dense = np.zeros((len(own), min(TERMS_AT_ONCE, len(vocabulary) - low)), np.int64)
            dense[row[inside], col[inside] - low] = weights[first:last][inside]
            split(tile, vocabulary[low : low + TERMS_AT_ONCE], dense)
        out.append(tile)
    return out


def split(tile: Tile, vocabulary: np.ndarray, dense: np.ndarray) -> None:
    """Halve a block until no item's sum of weights times impacts can reach 2**53."""
    most = max(sum(map(int, r)) for r in dense) if len(dense) else 0
    if most * IMPACT_LIMIT < EXACT_SUM:
        tile.blocks.append((vocabulary, dense.astype(np.float64)))
    elif len(vocabulary) == 1:
        tile.single.append((vocabulary, dense))
    else:
        half = len(vocabulary) // 2
        split(tile, vocabulary[:half], dense[:, :half])
        split(tile, vocabulary[half:], dense[:, half:])


def tile_scores(tile: Tile, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Scores (items x documents) of a document tile given by its entries."""
    scores = np.zeros((len(tile.items), docs), np.int64)

    def impacts(vocabulary: np.ndarray, kind: type) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        there = vocabulary[at] == term
        dense = np.zeros((len(vocabulary), docs), kind)
        dense[at[there], doc[there]] = impact[there]
        return dense

    for vocabulary, weights in tile.blocks:
        scores += (weights @ impacts(vocabulary, np.float64)).astype(np.int64)
    for vocabulary, weights in tile.single:
        scores += weights * impacts(vocabulary, np.int64)
    return scores


class Best:
    """The best documents of each item of a tile seen so far; equal scores by id, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.score = [np.zeros(0, np.int64)] * items
        self.id = [np.zeros(0, np.int64)] * items

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for i in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)):
            at = np.flatnonzero(scores[i] >= self.least[i])  # ties at the border included
            score, own = np.concatenate((self.score[i], scores[i, at])), np.concatenate((self.id[i], ids[at]))
            best = np.lexsort((own, -score))[: self.k]
            self.score[i], self.id[i] = score[best], own[best]
            if len(best) == self.k:
                self.least[i] = self.score[i][-1]


def tile_best(told: DataFrame, parts: list[Tile], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item number, id, score): the best ``k`` of every task for each item."""

    def flat(cell: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.asarray(cell.offsets).astype(np.int64)
        return np.diff(ends), np.asarray(cell.values)[ends[0] : ends[-1]]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(t.items), k) for t in parts]
        for whole in batches:
            for start in range(0, whole.num_rows, DOCUMENTS_AT_ONCE):
                batch = whole.slice(start, DOCUMENTS_AT_ONCE)
                ids = np.asarray(batch.column(0).fill_null(int(NO_ID)))
                per, term = flat(batch.column(2))
                _, times = flat(batch.column(3))
                doc = np.repeat(np.arange(batch.num_rows), per)
                m = 75 + (25 * np.asarray(batch.column(1)) * n_docs) // n_terms
                impact = (1_000_000_000 * times) // (1000 * times + 12 * m[doc])
                for tile, kept in zip(parts, best, strict=True):
                    kept.add(tile_scores(tile, batch.num_rows, doc, term, impact), ids)
        for tile, kept in zip(parts, best, strict=True):
            sizes = [len(s) for s in kept.score]
            if sum(sizes):
                ids = np.concatenate(kept.id)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(tile.items, sizes), pa.int32()), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate(kept.score))],
                    ["item", "id", "score"],
                )

    return told.mapInArrow(search, "item int, id long, score long")


def item_groups(entries: DataFrame, at_once: int) -> tuple[int, Column]:
    """(how many groups, group of an item): by hash, each of at most ``at_once`` entries or of one item."""
    parts = max(1, -(-entries.count() // at_once))
    while True:
        group = F.pmod(F.xxhash64("item"), F.lit(parts))
        per_item = entries.groupBy("item").count()
        large = per_item.groupBy(group).agg(F.sum("count").alias("all"), F.count("*").alias("items")).where(f"all > {at_once} and items > 1")
        if parts == 1 << 20 or not large.head(1):
            return parts, group
        parts *= 2


def ranked(
    documents: DataFrame,
    items: DataFrame,
    k: int = BEST,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    entries_at_once: int = ENTRIES_AT_ONCE,
) -> DataFrame:
    """(item, rank, id, score): for each item its ``k`` documents of the highest scores above 0, equal scores by ascending id.

    Every document is compared with every item. Item entries (an item's distinct terms) are taken in groups of ``entries_at_once``, which bounds
    what is sent to tasks; one more item than that in a group is only possible where a single item is larger. Texts are read once for each
    group.

    Null and empty texts, and texts without terms, count nowhere and are never found; an item without terms finds nothing, so does any item in an
    empty table. Rows that repeat an item's id (null included) are one item with all their terms. Rows that repeat a document's id are
    documents of their own; ids that are null come last among equal scores. Other columns are not looked at. The columns
    of the result are named after ``item_column`` and ``id_column``.
    """
    item_terms = items.select(
        column(item_column).alias("item"),
        F.explode(F.regexp_extract_all(F.translate(column(item_text_column), UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))).alias("term"),
    )
    entries = written(item_terms.groupBy("item", "term").agg(F.count("*").alias("times")), "item-terms")
    parts, group = item_groups(entries, entries_at_once)
    found = []
    for number in range(parts):
        mine = entries.where(group == number).toArrow().combine_chunks()
        item_ids = mine.column("item").unique()
        names = mine.column("term").unique().to_pylist()
        if not names:
            continue
        told = written(document_terms(documents, names, id_column, text_column), "document-terms")
        n_docs, n_terms = told.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = dict(told.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most a row per term of the group
        weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for i, df in held.items()}

        place = {t: i for i, t in enumerate(names)}
        of_item = {v: i for i, v in enumerate(item_ids.to_pylist())}
        row = np.array([of_item[v] for v in mine.column("item").to_pylist()], np.int64)
        term = np.array([place[t] for t in mine.column("term").to_pylist()], np.int64)
        w = np.array([weight.get(int(t), 0) for t in term], np.int64) * np.asarray(mine.column("times"))
        order = np.lexsort((term, row))
        order = order[w[order] > 0]
        best = tile_best(told, tiles(row[order], term[order], w[order]), n_docs, n_terms, k)
        numbers = documents.sparkSession.createDataFrame(
            pa.table({"item": pa.array(range(len(item_ids)), pa.int32()), "name": item_ids.cast(mine.column("item").type)})
        )
        found.append(best.join(numbers, "item").select("name", "id", "score"))
    if not found:
        kind = items.schema[item_column].dataType.simpleString()
        none = documents.sparkSession.createDataFrame([], f"name {kind}, id long, score long")
        found.append(none)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)

    order = (F.desc("score"), F.asc_nulls_last("id"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    some = every.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("name", "salt").orderBy(*order))).where(f"rank <= {k}")
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(f"rank <= {k}")
    return last.select(F.col("name").alias(item_column), "rank", F.col("id").alias(id_column), "score")
