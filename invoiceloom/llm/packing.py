"""Documents cut to pieces of a length and packed into as few sequences as possible.

Lengths are whole numbers up to the length of a sequence, so the corpus is told in full by its counts of pieces per length: a table
of at most that many numbers however large the corpus. The driver plans on those counts by bin completion: around the
largest length left it enumerates fillings that no other one dominates, cuts branches whose waste can't beat the best solution
known, and keeps best-fit solutions as such. Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoiceloom.llm.byte_bpe import Remembered, shown
from invoiceloom.llm.rows import column, written

SEQUENCE = 2048
END_ID = 0
SALTS = 64
SEARCH_NODES = 60_000
FILLINGS_TRIED = 4
FILLING_STEPS = 400
CACHE_WORDS = 400_000
WORDS_AT_ONCE = 500
MARK = "\x01"
ADDED = "<|"  # stands in every added token
SLICE_CHARACTERS = 1 << 18

Plan = list[tuple[int, tuple[int, ...]]]
"""Rows (how many sequences, lengths in them from the largest)."""

#: White space of the tokenizer's pattern; ``str.split`` also splits at these four.
NOT_BLANK = re.compile("[\x1c-\x1f]")
WORD = re.compile(r"[^\t-\r \x85\xa0  -     　]+")


#: Texts of ASCII and accented Latin letters: NFC leaves them as they are, and lower case goes letter by letter.
NOT_LATIN = re.compile("[^\t-\r -~À-ÖØ-öø-įı-ſ]")
LATIN_PIECE = re.compile("'(?:[stmd]|re|ve|ll)|[a-zß-öø-ſ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ſ]+")
LATIN_RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def piece_model(tokenizer_json: str):
    """For a tokenizer with ``LATIN_RULES``: its model, for pieces already lower-cased whose bytes are shown as characters."""
    from tokenizers import Tokenizer

    config = json.loads(tokenizer_json)
    if any(config[k] != rule for k, rule in LATIN_RULES.items()) or any(ADDED not in t["content"] for t in config["added_tokens"]):
        return None
    return Tokenizer.from_str(json.dumps({**config, "normalizer": None, "pre_tokenizer": None, "added_tokens": []})).model


class WordEncoder:
    """Ids of words that white space separates, from a tokenizer whose tokens never reach across white space.

    The tokenizer is used as it is: the strings of its added tokens become their ids, also inside a word.

    Latin texts are cut to the pieces that the tokenizer's own rules make of them, letters, digits and signs, others to words. A distinct one
    is encoded once for as long as the bounded cache holds it; a text is the concatenation of its own. New pieces go to the tokenizer's model
    as they are met, new words to the tokenizer, many at a time: words end at a mark with an id of its own.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer_json = tokenizer_json
        self.model = piece_model(tokenizer_json)
        self.cache = Remembered(self.piece_ids, {})

    @cached_property
    def tokenizer(self):
        """Made when a text first needs it: a worker that meets Latin texts only holds one vocabulary."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.tokenizer_json)

    @cached_property
    def mark_id(self) -> int | None:
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        return mark[0] if len(mark) == 1 else None

    def piece_ids(self, piece: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(shown(piece))]).tobytes()

    def new(self, parts: set[str]) -> list[str]:
        """Those that the cache doesn't hold."""
        cache = self.cache
        unknown = parts.difference(cache)
        again = {x: cache.older[x] for x in unknown if x in cache.older}
        cache.update(again)
        return [x for x in unknown if x not in again]

    def learn(self, words: set[str]) -> None:
        together = []
        for word in self.new(words):
            if MARK in word or self.mark_id is None:
                self.cache[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                together.append(word)
        for at in range(0, len(together), WORDS_AT_ONCE):
            part = together[at : at + WORDS_AT_ONCE]
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.mark_id) * 4
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, [*ends.tolist(), len(raw)], strict=True):
                self.cache[word] = raw[start:end]
                start = end + 4

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit numbers, in parts."""
        at = 0
        while at < len(text):
            end = at + SLICE_CHARACTERS
            while end < len(text) and not text[end].isspace():
                end += 1
            part = text[at:end]
            self.cache = self.cache.bounded(CACHE_WORDS)
            if self.model is None or NOT_LATIN.search(part) or ADDED in part:
                parts = WORD.findall(part) if NOT_BLANK.search(part) else part.split()
                self.learn(set(parts))
            else:
                parts = LATIN_PIECE.findall(part.lower())
            yield b"".join(map(self.cache.__getitem__, parts))
            at = end


@lru_cache(maxsize=1)
def word_encoder(tokenizer_json: str) -> WordEncoder:
    """One for each worker process, kept from task to task."""
    return WordEncoder(tokenizer_json)


def piece_rows(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): texts encoded, ended by id 0 and cut where longer than ``length``.

    Null and empty texts are the end id alone. Rows that repeat an id are documents of their own.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()  # 2 MB, sent along with the task's code

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # a worker is used again by stage after stage
        encoder = word_encoder(tokenizer_json)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            row, piece, start, size, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                cell = batch.column(1)[i].as_py() or ""
                ids = memoryview(b"".join([*encoder.encode(cell), end]))
                total = len(ids) // 4
                for number, at in enumerate(range(0, total, length)):
                    n = min(length, total - at)
                    row.append(i)
                    piece.append(number)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    source = df.select(column(id_column).alias("id"), column(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


# Planning on counts -----------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], size: int = SEQUENCE) -> Plan:
    """Best fit in order of decreasing length, sequences of equal content handled together."""
    opened: dict[int, list[list]] = {}  # room left: [how many, lengths]
    for item in sorted(counts, reverse=True):
        left = counts[item]
        while left:
            room = min((r for r in opened if r >= item), default=None)
            if room is None:
                per = min(size // item, left)
                n = max(left // per, 1)
                opened.setdefault(size - per * item, []).append([n, (item,) * per])
                left -= n * per
                continue
            group = opened[room][-1]
            n = min(group[0], left)
            group[0] -= n
            if group[0] == 0:
                opened[room].pop()
                if not opened[room]:
                    del opened[room]
            opened.setdefault(room - item, []).append([n, (*group[1], item)])
            left -= n
    return [(n, lengths) for groups in opened.values() for n, lengths in groups]


def fillings(counts: Counter, lengths: list[int], room: int, most_waste: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of the best few ways to fill ``room``; none wastes more than ``most_waste``.

    Lengths are tried from the largest, so of fillings with equal sums that with the larger parts comes first; a filling that another length
    still fits in is dominated and not kept. The search ends after some steps: it bounds effort, every piece gets a place anyway.
    """
    found: dict[int, tuple[int, ...]] = {}
    smallest, steps = lengths[-1] if lengths else room + 1, 0
    neg = [-x for x in lengths]
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, 0, ())]
    while stack and steps < FILLING_STEPS and not (0 in found and len(found) >= FILLINGS_TRIED):
        left, at, chosen = stack.pop()
        steps += 1
        i = max(at, bisect_left(neg, -left))
        while i < len(lengths) and chosen.count(lengths[i]) >= counts[lengths[i]]:
            i += 1
        if i == len(lengths):
            if left <= most_waste and (left < smallest or all(left < x or chosen.count(x) >= counts[x] for x in lengths[at:])):
                found.setdefault(left, chosen)
            continue
        # first take the largest that fits, later the same room without it
        if i + 1 < len(lengths):
            stack.append((left, i + 1, chosen))
        elif left <= most_waste and chosen and left < smallest:
            found.setdefault(left, chosen)
        stack.append((left - lengths[i], i, (*chosen, lengths[i])))
    return sorted(found.items())[:FILLINGS_TRIED]


def complete(counts: dict[int, int], target: int, size: int, nodes: int) -> Plan | None:
    """A plan of at most ``target`` sequences by depth-first bin completion, or none within the nodes allowed."""
    total = sum(k * n for k, n in counts.items())
    left, allowed = Counter(counts), target * size - total
    if allowed < 0:
        return None
    lengths = sorted(counts, reverse=True)
    plan: list[tuple[int, tuple[int, ...], int]] = []
    choices: list[list[tuple[int, tuple[int, ...]]]] = []

    def open_level() -> None:
        largest = next(x for x in lengths if left[x])
        left[largest] -= 1
        there = [x for x in lengths if left[x] and x <= size - largest]
        found = fillings(left, there, size - largest, allowed)
        left[largest] += 1
        choices.append([(waste, (largest, *more)) for waste, more in reversed(found)])

    remaining = total
    open_level()
    while nodes:
        nodes -= 1
        if not choices[-1]:
            choices.pop()
            if not plan:
                return None
            n, lengths_in, waste = plan.pop()
            for x in lengths_in:
                left[x] += n
            allowed += n * waste
            remaining += n * (size - waste)
            continue
        waste, chosen = choices[-1].pop()
        parts = Counter(chosen)
        n = min(left[x] // k for x, k in parts.items())
        if waste:
            n = min(n, allowed // waste)
        if n < 1:
            continue
        for x, k in parts.items():
            left[x] -= n * k
        allowed -= n * waste
        remaining -= n * (size - waste)
        plan.append((n, chosen, waste))
        if remaining == 0:
            return [(n, x) for n, x, _ in plan]
        open_level()
    return None


def plan_sequences(counts: dict[int, int], size: int = SEQUENCE, nodes: int = SEARCH_NODES) -> Plan:
    """The plan with the fewest sequences found. ``nodes`` bounds the search beyond best fit."""
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit(counts, size)
    used = sum(n for n, _ in best)
    least = -(-sum(k * n for k, n in counts.items()) // size)
    target = least
    while target < used and nodes > 0:
        share = max(nodes // 2, 1)
        found = complete(counts, target, size, share)
        nodes -= share
        if found is not None:
            return found
        target = max(target + 1, (target + used) // 2)
    return best


def place_columns(plan: Plan, offsets: np.ndarray, length: Column, salt: Column, rank: Column) -> Column:
    """A struct (sequence_id, offset) for the piece that is number ``rank`` of its length and salt."""
    per: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    first = 0
    for n, lengths in plan:
        at = 0
        for x, k in sorted(Counter(lengths).items(), reverse=True):
            per.setdefault(x, []).append((taken[x], first, k, at))
            taken[x] += n * k
            at += x * k
        first += n
    slots = {x: np.array(rows, np.int64).T for x, rows in per.items()}

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        size, s, r = (np.asarray(x) for x in (length, salt, rank))
        number = r + offsets[size, s]
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        borders = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            rows = order[a:b]
            low, start, k, at = slots[int(size[rows[0]])]
            i = np.searchsorted(low, number[rows], "right") - 1
            j = number[rows] - low[i]
            sequence[rows] = start[i] + j // k[i]
            offset[rows] = at[i] + (j % k[i]) * size[rows]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    return place(length, salt, rank)


def packed_documents(
    df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", length: int = SEQUENCE
) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every piece of every row has one place; places in a sequence follow each other without gaps from 0. An empty table gives an empty one.
    Other columns of ``df`` are not looked at.
    """
    pieces = piece_rows(df, tokenizer_path, id_column, text_column, length)
    salt = F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    kept = written(pieces.withColumn("salt", salt).withColumn("number", F.monotonically_increasing_id()), "pieces")  # small rows; the texts are encoded once
    # a full piece is a sequence of its own: the commonest length needs neither plan nor rank
    full, partly = kept.where(F.col("length") == length), kept.where(F.col("length") < length)
    counted = partly.groupBy("length", "salt").count().collect()  # at most length * SALTS rows
    counts = np.zeros((length + 1, SALTS), np.int64)
    for row in counted:
        counts[row["length"], row["salt"]] = row["count"]
    before = np.cumsum(counts, axis=1) - counts
    plan = plan_sequences({x: int(n) for x, n in enumerate(counts.sum(axis=1)) if n}, length)
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = partly.withColumn("rank", rank.cast("long"))
    placed = ranked.withColumn("place", place_columns(plan, before, F.col("length"), F.col("salt"), F.col("rank")))
    columns = [F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32"]
    first = sum(n for n, _ in plan)
    alone = full.select(*columns, (F.col("number") + first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*columns, "place.sequence_id", "place.offset").unionByName(alone)
