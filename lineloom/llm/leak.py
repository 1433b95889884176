"""Evaluation passages that stand, wholly or partly, inside a training corpus (problem 8).

Greedy string tiling. Words are runs of letters and digits in lower case. Rolling Karp-Rabin hashes of every ``RUN``
words of a document are looked up among those of the evaluation items; each document and item with a shared run is a
candidate. Its seeds are joined into maximal matches, and the match with the most unmarked item words is marked as a
tile, again and again, until no match has any left. Words are marked on the item's side only, so tiles never overlap in
the item, a document's words may serve again, and the words of all tiles are exactly the item's words that lie in shared
runs. That coverage is what the threshold is held against. Reordered passages are several tiles.

Items of up to ``BLOCK_WORDS`` words in all are sent to the workers as an index, and words are compared. Larger sets are
joined to the documents by 128-bit hashes of runs, which then decide. Null and empty texts, and items under ``RUN``
words, are in no result. Rows with the same id count as one.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WordHashes, mix64, row_chunks

RUN = 5
SHARE = 0.5
BLOCK_WORDS = 2_000_000

_WORDS = re.compile(r"[^\W_]+")
#: ASCII characters that separate words, as blanks.
_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    low = text.lower()
    return low.translate(_BLANKS).split() if low.isascii() else _WORDS.findall(low)


def rolling(ids: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of every ``RUN`` consecutive words."""
    n = len(ids) - RUN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    v = ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(RUN):
            h = h * _BASE + v[j : j + n]
        return h ^ (h >> np.uint64(29))


class Items:
    """A block of evaluation items: words as numbers, and where each run of words stands."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.id: list[int] = []
        hashes, places = [], []
        for item, text in items:
            w = np.array([self.vocab.setdefault(x, len(self.vocab)) for x in words_of(text)], np.int64)
            if len(w) < RUN:
                continue
            k = len(self.id)
            self.id.append(item)
            self.words.append(w)
            h = rolling(w)
            hashes.append(h)
            places.append(np.stack([np.full(len(h), k), np.arange(len(h))], axis=1))
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.places = np.concatenate(places) if places else np.empty((0, 2), np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places = self.hashes[order], self.places[order]


def maximal(seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """(item position, document position, words) of the maximal matches of seeds (item position, document position)."""
    diagonal = seeds[:, 1] - seeds[:, 0]
    order = np.lexsort((seeds[:, 0], diagonal))
    s, g = seeds[order], diagonal[order]
    new = np.ones(len(s), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:, 0] != s[:-1, 0] + 1)
    at = np.flatnonzero(new)
    stop = np.append(at[1:], len(s))
    return [(int(s[a, 0]), int(s[a, 1]), int(b - a) + RUN - 1) for a, b in zip(at, stop)]


def tile(matches: list[tuple[int, int, int]], item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiling by maximal matches: most unmarked words first, each word of the item in one tile."""
    marked = np.zeros(item_words, bool)
    heap = [(-n, p, d) for p, d, n in matches]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, p, d = heapq.heappop(heap)
        n = -n
        taken = marked[p : p + n]
        if not taken.any():
            marked[p : p + n] = True
            tiles.append((p, d, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(edge[::2], edge[1::2]):
            heapq.heappush(heap, (-int(b - a), p + int(a), d + int(a)))
    return tiles


def tiled(seeds: np.ndarray, item_words: int) -> tuple[int, int, int, bool]:
    """(tiles, words in tiles, longest tile, whether tiles stand in another order in the document) of seeds."""
    tiles = tile(maximal(seeds), item_words)
    in_doc = [t[1] for t in sorted(tiles)]
    return len(tiles), sum(t[2] for t in tiles), max(t[2] for t in tiles), in_doc != sorted(in_doc)


_LEAKS = "doc_id long, item_id long, item_words int, tiles int, tiled int, longest int, reordered boolean"
#: Seeds that one step of a worker holds, unless a single document has more.
STEP_SEEDS = 4_000_000


def _numbers(texts: list, vocab: dict[str, int]) -> list[np.ndarray]:
    """Words of each text as numbers of ``vocab``, -1 for any other."""
    out = []
    for t in texts:
        words = words_of(t) if t else []
        out.append(np.fromiter(map(vocab.get, words, repeat(-1)), np.int64, len(words)))
    return out


def _scanner(items: Items):
    item_base = np.concatenate([[0], np.cumsum([len(w) for w in items.words])]).astype(np.int64)
    item_words = np.concatenate(items.words) if items.words else np.empty(0, np.int64)
    item_size = np.diff(item_base)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for at, texts in row_chunks(batch, 1):
                docs = _numbers(texts, items.vocab)
                size = np.array([len(d) for d in docs])
                base = np.concatenate([[0], np.cumsum(size)])
                flat = np.concatenate(docs)
                h = rolling(flat)
                if not len(h) or not len(items.id):
                    continue
                known = np.cumsum(np.concatenate([[0], flat < 0]))
                doc_of = np.repeat(np.arange(len(docs)), size)
                pos = np.flatnonzero((known[RUN:] - known[: len(h)] == 0) & (doc_of[: len(h)] == doc_of[RUN - 1 :]))
                lo = np.searchsorted(items.hashes, h[pos], "left")
                n = np.searchsorted(items.hashes, h[pos], "right") - lo
                for a, b in _steps(doc_of[pos], n):
                    out += pairs(docs, ids, at, base, doc_of, flat, pos[a:b], lo[a:b], n[a:b])
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.int32()) for x in c[2:6]), pa.array(c[6], pa.bool_())],
                    names=["doc_id", "item_id", "item_words", "tiles", "tiled", "longest", "reordered"],
                )

    def pairs(docs: list, ids: list, at: int, base: np.ndarray, doc_of: np.ndarray, flat: np.ndarray, pos: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple]:
        p = np.repeat(pos, n)
        place = items.places[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = item_base[place[:, 0]] + place[:, 1]
        same = np.ones(len(p), bool)
        for j in range(RUN):
            same &= item_words[start + j] == flat[p + j]
        p, place = p[same], place[same]
        key = doc_of[p] * len(items.id) + place[:, 0]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        out = []
        for part in np.split(order, first[1:]) if len(order) else []:
            doc, item = divmod(int(key[part[0]]), len(items.id))
            out.append((ids[at + doc], items.id[item], int(item_size[item]), *tiled(np.stack([place[part, 1], p[part] - base[doc]], axis=1), int(item_size[item]))))
        return out

    return scan


def _steps(doc: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of positions with at most ``STEP_SEEDS`` seeds, or of one document."""
    if not len(n):
        return []
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    upto = np.cumsum(n)
    cuts, start = [0], 0
    for a, b in zip(first, np.append(first[1:], len(n))):
        if a > cuts[-1] and upto[b - 1] - start > STEP_SEEDS:
            cuts.append(int(a))
            start = int(upto[a - 1])
    return list(zip(cuts, [*cuts[1:], len(n)]))


_RUNS = "id long, text_key long, words int, pos int, h1 long, h2 long"


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for at, texts in row_chunks(batch, 1):
            words = [np.fromiter(map(cache.__getitem__, words_of(t)), np.uint64) if t else np.empty(0, np.uint64) for t in texts]
            size = np.array([len(w) for w in words])
            flat = np.concatenate(words)
            doc = np.repeat(np.arange(len(texts)), size)
            h1 = rolling(flat)
            if not len(h1):
                continue
            h2 = rolling(mix64(flat))
            ok = np.flatnonzero(doc[: len(h1)] == doc[RUN - 1 :])
            key = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
            ids = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)
            d = doc[ok]
            pos = ok - (np.cumsum(size) - size)[d]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[d], pa.int64()), pa.array(key[d]), pa.array(size[d].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(h1[ok].view(np.int64)), pa.array(h2[ok].view(np.int64))],
                names=["id", "text_key", "words", "pos", "h1", "h2"],
            )


def _tile_group(seeds: pd.DataFrame) -> pd.DataFrame:
    r = seeds.iloc[0]
    out = tiled(seeds[["item_pos", "doc_pos"]].to_numpy(np.int64), int(r.item_words))
    return pd.DataFrame([(r.doc_id, r.item_id, r.item_words, *out)], columns=["doc_id", "item_id", "item_words", "tiles", "tiled", "longest", "reordered"])


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As :func:`leaks`, by a shuffle join of hashed runs: for items that are too many to be sent to the workers."""
    d = docs.select("doc_id", "text").mapInArrow(_run_batches, _RUNS).select(F.col("id").alias("doc_id"), F.col("text_key").alias("doc_key"), F.col("pos").alias("doc_pos"), "h1", "h2")
    i = items.select("item_id", "text").mapInArrow(_run_batches, _RUNS).select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), F.col("words").alias("item_words"), F.col("pos").alias("item_pos"), "h1", "h2")
    return d.join(i, ["h1", "h2"]).groupBy("doc_id", "doc_key", "item_id", "item_key").applyInPandas(_tile_group, _LEAKS)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every document and item that share a run of ``RUN`` words, with the item's tiles.

    docs: doc_id, text; items: item_id, text. tiled counts the item's words that lie in shared runs.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    most = items.agg(F.sum((F.length("text") + 1) / 2)).first()[0] or 0  # a word and what ends it have two characters at least
    if most > BLOCK_WORDS:
        return joined(rows, items)
    return rows.mapInArrow(_scanner(Items([(r.item_id, r.text) for r in items.collect()])), _LEAKS)


def leaked(found: DataFrame) -> DataFrame:
    """doc_id, item_id with at least half of the item's words in tiles (once each)."""
    return found.where(F.col("tiled") >= SHARE * F.col("item_words")).select("doc_id", "item_id").distinct()
