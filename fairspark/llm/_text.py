"""Vectorised word hashing over Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All functions work on whole texts; a null text has
no words.  Hashes are 64-bit, the same in every process, and computed from the words' UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """The first n values of a fixed random stream."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = stream64(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = stream64(1 << 12, 23) | np.uint64(1)
_GRAM = stream64(256, 37) | np.uint64(1)


class Texts(NamedTuple):
    """UTF-8 of several texts end to end; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte ranges and hashes of all words; text i has words first[i] to first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))


def chunked(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with about ``limit`` bytes of text each (at least one row)."""
    if not batch.num_rows:
        return
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        lo, hi = texts.offsets[at], texts.offsets[to]
        yield batch.slice(at, to - at), Texts(texts.data[lo:hi], texts.offsets[at : to + 1] - lo)
        at = to


def words_of(texts: Texts, lower: bool = False) -> Words:
    data, offsets = texts
    word = ~_SPACE[data]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[inner] = word[inner]
    starts = np.flatnonzero(start)
    n = len(starts)
    if not n:
        return Words(starts, starts, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    at = np.flatnonzero(word)
    begins = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begins, len(at)))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    most = int(lengths.max())
    places = _PLACE if most <= len(_PLACE) else stream64(most, 23) | np.uint64(1)
    table = _BYTE_LOWER if lower else _BYTE
    hashes = mix64(np.add.reduceat(table[data[at]] * places[place], begins))
    return Words(starts, starts + lengths, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, by first word; texts are not told apart here."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * _GRAM[k]
    return mix64(total)


def whole(hashes: np.ndarray) -> np.uint64:
    """A hash of a whole sequence of words, length included."""
    places = stream64(len(hashes) + 1, 41) | np.uint64(1)
    return mix64(np.add.reduce(hashes * places[:-1], keepdims=True) + places[-1:] * np.uint64(len(hashes)))[0]


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each text, end to end, and their offsets.

    A text with fewer than n words but at least one has its whole word sequence as its only shingle.
    """
    counts = np.diff(words.first)
    many = np.maximum(counts - n + 1, 0)
    texts = np.repeat(np.arange(len(counts)), many)
    at = np.arange(len(texts)) - np.repeat(np.cumsum(many) - many, many) + words.first[:-1][texts]
    values = grams(words.hashes, n)[at] if len(at) else np.empty(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        values = np.concatenate([values, np.array([whole(words.hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)])
        texts = np.concatenate([texts, short])
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    values, texts = values[keep], texts[keep]
    return values, np.searchsorted(texts, np.arange(len(counts) + 1))
