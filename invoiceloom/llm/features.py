"""Hashed features of texts, computed on the bytes of an Arrow column.

Texts are taken as the UTF-8 bytes Arrow already holds; words, their hashes and n-grams come from whole-array operations.
Work goes in runs of a few documents (or pieces of one long document), so memory follows the run and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20

_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32
CONTINUES = (np.arange(256) & 0xC0) == 0x80

#: Kinds of bytes, a bit each: lower, upper, digit, sentence marks, other ASCII marks, beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[ord("a") : ord("z") + 1] = 1
KIND[ord("A") : ord("Z") + 1] = 2
KIND[ord("0") : ord("9") + 1] = 4
for _b in range(0x80):
    if KIND[_b] == 0 and not SEPARATOR[_b]:
        KIND[_b] = 8 if chr(_b) in ".,;:!?'\"()-" else 16
KIND[0x80:] = 32
NEWLINE = np.arange(256) == 0x0A


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``RUN_BYTES`` together, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


@dataclass
class Words:
    """Words of some documents in order: hash, number of the document, code points, kinds of bytes."""

    hashes: np.ndarray
    doc: np.ndarray
    chars: np.ndarray
    kinds: np.ndarray


def _pieces(data: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``RUN_BYTES`` that end before a separator."""
    at, n = 0, len(data)
    while at < n:
        end = at + RUN_BYTES
        while end < n:
            found = np.flatnonzero(separator[data[end : end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end += 4096
        yield at, min(end, n)
        at = min(end, n)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the documents at ``offsets`` (from 0) in ``data``; with ``NEWLINE``, lines that aren't empty."""
    found = []
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    for a, b in _pieces(data, separator):
        part = data[a:b]
        inside = ~separator[part]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | border[a:b]))
        if len(starts) == 0:
            continue
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | border[a + 1 : b + 1])) + 1
        powers = np.full(len(part), BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[TO_LOWER[part] if lower else part] * powers, out=sums[1:])
        powers[1:] = BASE_INVERSE
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        points = np.zeros(len(part) + 1, np.int32)
        np.cumsum(~CONTINUES[part], out=points[1:])
        kinds = np.bitwise_or.reduceat(np.where(inside, KIND[part], np.uint8(0)), starts)
        found.append((
            mixed((sums[ends] - sums[starts]) * powers[starts]),
            (np.searchsorted(offsets, starts + a, "right") - 1).astype(np.int32),
            points[ends] - points[starts],
            kinds,
        ))
    if not found:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))
    return Words(*(np.concatenate(x) for x in zip(*found, strict=True)))


def ngrams(codes: np.ndarray, doc: np.ndarray, n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the document) of every n-gram inside a document."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    total = np.full(len(codes) - n + 1, family, np.uint64)
    for i in range(n):
        total = total * BASE + codes[i : len(codes) - n + 1 + i]
    same = doc[: len(doc) - n + 1] == doc[n - 1 :]
    return mixed(total[same]), doc[: len(doc) - n + 1][same]


def code_points(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where it begins, number) of every character; bytes of one that began before are passed over."""
    at = np.flatnonzero(~CONTINUES[part])
    code = part[at].astype(np.uint64)
    size = 1 + (code >= 0xC0).astype(np.int64) + (code >= 0xE0) + (code >= 0xF0)
    for k in (1, 2, 3):
        more = size > k
        code[more] = (code[more] << np.uint64(6)) | (part[np.minimum(at[more] + k, len(part) - 1)] & 0x3F).astype(np.uint64)
    lead = np.array([0, 0, 0xC0 << 6, 0xE0 << 12, 0xF0 << 18], np.uint64)
    return at, code - lead[size]


def char_ngrams(data: np.ndarray, offsets: np.ndarray, n: int, family: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Like :func:`ngrams` over the characters of the texts, A-Z lower-cased, in slices of ``RUN_BYTES``; n is at most 4."""
    first = int(np.searchsorted(offsets, 0, "right")) - 1
    for at in range(0, len(data), RUN_BYTES):
        part = TO_LOWER[data[at : at + RUN_BYTES + 4 * n]]
        borders = np.clip(offsets[first:], at, at + len(part))
        doc = np.repeat(np.arange(first, len(offsets) - 1, dtype=np.int32), np.diff(borders))
        begin, code = code_points(part)
        doc = doc[begin]
        code = np.where(code < 256, code, code * BASE)
        grams = min(int(np.searchsorted(begin, RUN_BYTES)), len(begin) - n + 1)
        if grams <= 0:
            continue
        # the characters of a position as one number, then one multiplication spreads them over the high bits
        total = np.zeros(grams, np.uint64)
        for i in range(n):
            total += code[i : grams + i] << np.uint64(8 * i)
        total = (total + np.uint64(family << 40)) * BASE
        same = doc[:grams] == doc[n - 1 : grams + n - 1]
        yield total[same], doc[:grams][same]


def back_distance(words: Words) -> np.ndarray:
    """0, or how many words back (1 to 3) the same word stood in the same document."""
    out = np.zeros(len(words.hashes), np.uint64)
    for back in (3, 2, 1):
        same = (words.hashes[back:] == words.hashes[:-back]) & (words.doc[back:] == words.doc[:-back])
        out[back:][same] = back
    return out


def distinct(hashes: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature below 2**bits, document), sorted by document."""
    keys = (doc.astype(np.uint64) << np.uint64(bits)) | (hashes >> np.uint64(64 - bits))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), (keys >> np.uint64(bits)).astype(np.int64)
