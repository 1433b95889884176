"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

A text is cut into slices without a regular expression. Every code point has a class (letter, number, white space,
other); runs of one class are the units. What a run does to the next one - give it its last blank, or take its first
letters as a contraction - is a transition function over four states, and the state in which each run begins is the
composition of the functions before it. Composition is associative, so it is computed for all runs at once by doubling
until every function is constant. Slices go to a cache of merged pairs; their starts are kept for decoding.

The vocabulary file is a parameter, read once by a worker from the place all machines have it at. Null and empty texts
have the empty list of ids. No special token is ever made: their strings in a text are ordinary text. Text that is no
valid Unicode (lone surrogates) is read with replacement characters.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import list_column, row_chunks

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slices after which a worker's cache is emptied.
CACHE_SLICES = 400_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points with the property White_Space.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a slice of their own with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

FRESH, BLANK, ONE, TWO = 0, 1, 2, 3
#: Put between slices to cut them all at once; texts that hold it are cut one slice at a time.
SEPARATOR = 0x10FFFF


def class_table() -> np.ndarray:
    """Class of every code point."""
    import sys
    import unicodedata

    t = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    t[:] = np.fromiter((kinds.get(category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, 0x110000)
    t[WHITE] = SPACE
    return t


def compose(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """State after each run: prefix compositions of the rows of ``f`` (runs, states), restarted where ``first``.

    A row is constant once its past cannot matter; only the others are composed further, with twice the reach each time.
    """
    f = f.copy()
    f[first] = f[first][:, :1]
    open_ = np.flatnonzero((f != f[:, :1]).any(axis=1))
    reach = 1
    while len(open_):
        before = f[open_ - reach]
        f[open_] = np.take_along_axis(f[open_], before.astype(np.int64), axis=1)
        open_ = open_[(f[open_] != f[open_][:, :1]).any(axis=1)]
        reach *= 2
    return f[:, 0]


def slice_starts(points: np.ndarray, doc_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """First code points of all slices of concatenated texts; ``doc_starts`` are those of non-empty texts."""
    n = len(points)
    cls = table[points]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new[doc_starts] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kind = cls[start]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    first = first[start]
    last = np.append(first[1:], True)

    f = np.zeros((len(start), 4), np.int8)
    gives = (kind == SPACE) & ~last & (points[end - 1] == 0x20)
    f[gives] = BLANK
    quote = np.flatnonzero((kind == OTHER) & (end - start == 1) & (points[start] == 0x27) & ~last)
    if len(quote):
        room = end[quote + 1] - start[quote + 1]
        a = points[start[quote + 1]]
        b = np.where(room > 1, points[np.minimum(start[quote + 1] + 1, n - 1)], 0)
        letter = kind[quote + 1] == LETTER
        takes = np.zeros(len(quote), np.int8)
        for c in CONTRACTIONS:
            hit = letter & (a == ord(c[0])) & ((b == ord(c[1])) if len(c) == 2 else True) & (takes == 0)
            takes[hit] = ONE if len(c) == 1 else TWO
        f[quote, FRESH] = takes
        f[quote, ONE] = takes
        f[quote, TWO] = takes
    after = compose(f, first)
    state = np.empty(len(start), np.int8)
    state[0] = FRESH
    state[1:] = after[:-1]
    state[first] = FRESH

    mark = np.zeros(n + 1, bool)
    mark[start[(state == FRESH) | (kind == SPACE)]] = True
    mark[start[state == BLANK] - 1] = True
    for s, k in ((ONE, 1), (TWO, 2)):
        at = (state == s) & (end - start > k)
        mark[start[at] + k] = True
    wide = (kind == SPACE) & ~last & (end - start > 1)
    mark[end[wide] - 1] = True
    return np.flatnonzero(mark[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            k = nxt[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if prv[i] >= 0:
            p = prv[i]
            if (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class Slots(dict):
    """slice -> its number among the merged ones."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, piece: str) -> int:
        s = self[piece] = self.add(piece)
        return s


class Encoder:
    """Slices texts and merges each distinct slice once while the cache holds it."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        self.ranks = read_ranks(path)
        self.table = class_table()
        self._clear()

    def _clear(self) -> None:
        self.slot = Slots(self._add)
        self.fresh: list[list[int]] = []
        self.n_slots = self.n_flat = 0
        self.flat, self.begin = np.empty(1 << 16, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, piece: str) -> int:
        self.fresh.append(merge(piece.encode("utf-8"), self.ranks))
        return self.n_slots + len(self.fresh) - 1

    def _settle(self) -> None:
        """Moves newly merged slices to the buffers, which grow by doubling."""
        if not self.fresh:
            return
        sizes = np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))
        ids = np.fromiter((i for x in self.fresh for i in x), np.int64, int(sizes.sum()))
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n_slots + len(sizes) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.begin[self.n_slots + 1 : self.n_slots + 1 + len(sizes)] = self.n_flat + np.cumsum(sizes)
        self.n_slots, self.n_flat, self.fresh = self.n_slots + len(sizes), self.n_flat + len(ids), []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each text, slice starts within texts, ids of each slice, slices of each text)."""
        if len(self.slot) > CACHE_SLICES:
            self._clear()
        texts = [(t or "").encode("utf-16", "surrogatepass").decode("utf-16", "replace") if t and not t.isascii() else (t or "") for t in texts]
        size = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(size)])
        whole = "".join(texts)
        if not whole:
            z = np.zeros(0, np.int64)
            return z, np.zeros(len(texts), np.int64), z, z, np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = slice_starts(points, base[:-1][size > 0], self.table)
        if points.max() < SEPARATOR:
            at = np.zeros(len(points), np.int64)
            at[starts] = 1
            apart = np.full(len(points) + len(starts), SEPARATOR, np.uint32)
            apart[np.arange(len(points)) + np.cumsum(at)] = points
            pieces = apart.tobytes().decode("utf-32-le").split(chr(SEPARATOR))[1:]
        else:
            ends = np.append(starts[1:], len(points))
            pieces = map(whole.__getitem__, map(slice, starts.tolist(), ends.tolist()))
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(starts))
        self._settle()
        begin, flat = self.begin, self.flat
        count = begin[slots + 1] - begin[slots]
        total = int(count.sum())
        shift = np.repeat(begin[slots] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        ids = flat[np.arange(total) + shift]
        per_text = np.searchsorted(starts, base)
        slices = np.diff(per_text)
        upto = np.concatenate([[0], np.cumsum(count)])
        text_of = np.repeat(np.arange(len(texts)), slices)
        return ids, upto[per_text[1:]] - upto[per_text[:-1]], starts - base[text_of], count, slices


def pieces_of(ranks: dict[bytes, int]) -> dict[int, bytes]:
    return {v: k for k, v in ranks.items()}


def decode(ids: list[int], pieces: dict[int, bytes]) -> str:
    """The text of ids; bytes that are no valid UTF-8, as in a part of a character, become replacement characters."""
    return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace")


def _encoder(path: str) -> Encoder:
    """One encoder a worker process, kept across tasks."""
    import sys

    kept = sys.modules.setdefault("_lineloom_encoders", type(sys)("_lineloom_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, offsets: bool = False) -> DataFrame:
    """id, ids; with ``offsets`` also starts (code point at which each slice begins) and slice_ids (ids of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not os.path.exists(vocabulary):
            raise FileNotFoundError(vocabulary)
        encoder = _encoder(vocabulary)
        for batch in batches:
            for at, texts in row_chunks(batch, 1):
                ids, per_text, starts, count, slices = encoder.encode(texts)
                columns = [batch.column(0).slice(at, len(texts)), list_column(ids.astype(np.int32), per_text, pa.int32())]
                if offsets:
                    columns += [list_column(starts.astype(np.int32), slices, pa.int32()), list_column(count.astype(np.int32), slices, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "starts", "slice_ids"][: len(columns)])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>" + (", starts array<int>, slice_ids array<int>" if offsets else ""))
