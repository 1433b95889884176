"""Batch text helpers for Arrow-fed workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Most characters handled at once inside a worker; bounds its memory, not the text of a row.
CHUNK_CHARS = 2_000_000
#: Most rows handled at once (the row number within a chunk must fit in 12 bits).
CHUNK_ROWS = 2_000
#: Entries after which a worker's word cache is emptied.
CACHE_WORDS = 400_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over an array of uint64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """The ``seed``-th hash function of a family, applied to hashed elements."""
    with np.errstate(over="ignore"):
        return mix64(x + np.uint64(seed + 1) * _M3)


class WordHashes(dict):
    """word -> 52-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 12
        return v


def row_chunks(batch: pa.RecordBatch, text_col: int, max_chars: int = CHUNK_CHARS, max_rows: int = CHUNK_ROWS) -> Iterator[tuple[int, list]]:
    """(offset, texts) slices of a record batch, each at most ``max_chars`` characters or one row."""
    texts = batch.column(text_col)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > max_chars or i - start >= max_rows):
            yield start, texts.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, texts.slice(start).to_pylist()


def bag_elements(texts: list, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The bags of words of ``texts`` as sets: (row of each element, hashed (word, occurrence)).

    Words are what white space separates, in lower case; a word's k-th repeat is an element of its own, so the size
    of a set intersection is the size of the bag intersection. Elements come grouped by row. A null text has none.
    """
    keys = []
    for i, text in enumerate(texts):
        if text:
            words = text.lower().split()
            if words:
                h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
                keys.append(h | np.uint64(i << 52))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = np.concatenate(keys)
    k.sort()
    n = len(k)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(k[1:], k[:-1], out=first[1:])
    starts = np.flatnonzero(first)
    occ = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    row = (k >> np.uint64(52)).astype(np.int64)
    with np.errstate(over="ignore"):
        elem = mix64((k & np.uint64((1 << 52) - 1)) * _M3 + occ.astype(np.uint64))
    return row, elem


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of ``counts[i]`` consecutive ``values`` for row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
