"""Byte-level BPE in Arrow batches: ranked merges over the bytes of words.

A word, a match of the pattern, is merged once for as long as a worker's bounded memory of words holds it; a text's ids are those of its
words. Texts of any number spread over the tasks: no shuffle, nothing is learned from the corpus and nothing passes through the driver but the
rank file. Decoding puts the bytes of the pieces together again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm.rows import column, packed, unpacked

FREQUENT_WORDS = 400_000
TEXTS_AT_ONCE = 256


def white_space(pattern: str) -> str:
    """The pattern for ``regex``, whose ``\\s`` holds four control characters more than Unicode's white space."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


LATIN_END = 0x180
BEYOND_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of characters below ``LATIN_END``, their classes spelled out; none where it uses other classes."""
    of = lambda name: "".join(re.escape(chr(c)) for c in range(LATIN_END) if regex.match(rf"\p{{{name}}}", chr(c)))
    letters, numbers, blanks = of("L"), of("N"), of("White_Space")
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]")
    spelled = spelled.replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]")
    return None if re.search(r"\\[A-Za-z]", spelled) else re.compile(spelled)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def parsed(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, rank_file.splitlines())}


def read_ranks(path: str) -> dict[bytes, int]:
    return parsed(file_bytes(path))


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each piece of several bytes the two pieces that merges of lower rank leave of it."""
    out = {}
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            found = [ranks.get(x + y, rank) for x, y in zip(parts, parts[1:])]
            lowest = min(found)
            if lowest >= rank:
                raise ValueError(f"rank {rank} is no merge of two pieces of lower rank")
            at = found.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[rank] = ranks[parts[0]], ranks[parts[1]]
    return out


#: A printable character for each byte, as byte-level vocabularies are written.
PRINTED_AS_THEY_ARE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
SIGNS = {b: chr(b) for b in PRINTED_AS_THEY_ARE}
SIGNS |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in SIGNS)}


def shown(word: str) -> str:
    """A character for each byte, none of them white space."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", SIGNS[0x20])
    return word.encode().decode("latin-1").translate(SIGNS)


class Remembered(dict):
    """What ``made`` gives for a key, made when first asked for; ``older`` is the generation before, looked at first."""

    def __init__(self, made: Callable, older: dict):
        super().__init__()
        self.made, self.older = made, older

    def __missing__(self, key):
        known = self.older.get(key)
        self[key] = known = self.made(key) if known is None else known
        return known

    def bounded(self, size: int) -> Remembered:
        """This one, or a new generation once half of ``size`` is reached."""
        return self if len(self) <= size // 2 else Remembered(self.made, dict(self))


class Encoder:
    """Ids of texts for one rank file and word pattern; each piece of several bytes has to be a merge of two of lower rank.

    Of a piece's splits only its halves can stand side by side: nothing reaches over the ends of two pieces, so between them merges went
    as for the piece alone, which leaves its halves. So the ranks are a list of pair merges, which the ``tokenizers`` model does for a word.
    ``remembered`` words at most are kept, in two generations.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = FREQUENT_WORDS):
        from tokenizers.models import BPE

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("all bytes need a rank")
        vocabulary = {piece.decode("latin-1").translate(SIGNS): rank for piece, rank in ranks.items()}
        piece_of = {rank: piece for piece, rank in vocabulary.items()}
        merges = [(piece_of[left], piece_of[right]) for _, (left, right) in sorted(halves(ranks).items())]
        self.model = BPE(vocabulary, merges, cache_capacity=0)  # words are remembered here
        self.digits = {rank: str(rank) for rank in piece_of}
        self.any_words = regex.compile(white_space(pattern)).findall
        latin = latin_pattern(pattern)
        self.latin_words = None if latin is None else latin.findall
        self.remembered = remembered
        self.cache = Remembered(self.merged, {})

    def encode(self, text: str) -> str:
        """Decimal ids, joined by one space."""
        words = (self.any_words if self.latin_words is None or BEYOND_LATIN.search(text) else self.latin_words)(text)
        self.cache = self.cache.bounded(self.remembered)
        return " ".join(map(self.cache.__getitem__, words))

    def merged(self, word: str) -> str:
        """The pair of the lowest rank, leftmost first, is merged until none has a rank."""
        digits = self.digits
        return " ".join([digits[token.id] for token in self.model.tokenize(shown(word))])


@lru_cache(maxsize=1)
def text_encoder(rank_file: bytes, pattern: str, remembered: int) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(parsed(rank_file), pattern, remembered)


@lru_cache(maxsize=1)
def pieces_by_id(rank_file: bytes) -> pa.LargeBinaryArray:
    """The piece of each id at its place; ids without a piece are null."""
    ranks = parsed(rank_file)
    pieces = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pa.array(pieces, pa.large_binary())


def joined_pieces(ids: pa.Array, pieces: pa.LargeBinaryArray) -> pa.Array:
    """The pieces of each text's ids, one after the other: pieces taken in order lie side by side, only the borders of texts are new."""
    some = pc.fill_null(pc.not_equal(ids, ""), False)
    lists = pc.split_pattern(ids.filter(some), " ")
    taken = pieces.take(pc.cast(lists.flatten(), pa.int64()))
    if taken.null_count:
        raise ValueError("an id has no piece")
    n_pieces = np.zeros(len(ids), np.int64)
    n_pieces[np.asarray(some)] = pc.list_value_length(lists)
    borders = np.append(0, np.cumsum(np.asarray(pc.binary_length(taken)), dtype=np.int64))[np.append(0, np.cumsum(n_pieces))]
    joined = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(borders), taken.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(pc.is_null(ids), None, joined).cast(pa.binary())


def decoder(ranks_path: str) -> Callable[[Column], Column]:
    """From ids joined by one space to the bytes of their pieces, one after the other."""
    rank_file = file_bytes(ranks_path)

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        pieces = pieces_by_id(rank_file)
        parts = [joined_pieces(ids.slice(at, TEXTS_AT_ONCE), pieces) for at in range(0, len(ids), TEXTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decoded


def encoded(
    df: DataFrame, ranks_path: str, pattern: str, text_column: str = "text", frequent: int = FREQUENT_WORDS
) -> DataFrame:
    """``df`` with ``ids`` (decimal, joined by one space) and ``n_tokens``; null and empty texts have no ids.

    Each match of the pattern is encoded alone and without special tokens. Columns of ``df`` with these names are replaced. Repeated rows
    each get their ids; an empty table gives an empty one. A word of any length counts as one word. ``frequent`` bounds the words a worker
    remembers from text to text.
    """
    rank_file = file_bytes(ranks_path)
    Encoder(parsed(rank_file), pattern)  # a rank file that isn't trained raises its error here

    @F.arrow_udf("string")
    def ids_of(texts: pa.Array) -> pa.Array:
        encode = text_encoder(rank_file, pattern, frequent).encode
        return pa.array([encode(x.as_py()) for x in texts], pa.string())

    rows = df.select(packed(df), F.coalesce(column(text_column), F.lit("")).alias("body"))
    tokens = F.when(F.col("ids") == "", 0).otherwise(F.length("ids") - F.length(F.replace(F.col("ids"), F.lit(" "))) + 1)
    return unpacked(rows.withColumn("ids", ids_of(F.col("body"))), df.columns, {"ids": F.col("ids"), "n_tokens": tokens.cast("long")})
