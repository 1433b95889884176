"""Near-duplicate texts (problem 2): prefixes in one order, counted places, exact verification.

Two texts are near-same when both have at least ``MIN_WORDS`` words and their bags of words share at least ``SHARE`` of
the words of the longer one. Texts with one bag of words form a class; one row of a class stands for it in every
later step.

Candidates are exact: bags are sets of (word, occurrence) elements, all put in one order, the rarest first, and near-same
texts meet in their prefixes, about a quarter of each, in several places (:func:`prefixed`). Bits that hold parities of
hashed elements bound from below how many elements two texts don't share (:func:`apart`). Neither can lose a pair.

Verification is exact on hashed words (52 bits a word) of whole texts, and a class is a 128-bit key of its bag; words
themselves are not shipped.

Nulls and texts under ``MIN_WORDS`` words are in no pair; in groups they are rows of their own class without links.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import small_enough, stable
from .text import WordHashes, bag_elements, list_column, mix64, row_chunks, seeded

MIN_WORDS = 8
SHARE = 0.75
#: Coordinates of a sketch.
T = 240
#: An element in the prefixes of more classes than this is joined as a grid of blocks of this size.
BLOCK = 500

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketch(row: np.ndarray, elem: np.ndarray, n_rows: int, t: int = T) -> np.ndarray:
    """Fast similarity sketches, (n_rows, t) of uint64; every row must have an element. For estimates: no query uses them.

    Round i throws every element into a hashed bin with a hashed value; a bin keeps the smallest value of the first round
    that reached it. Rounds go on until every bin is filled; from round t on, round t + k throws everything into bin k.
    A coordinate holds round and value of its winner, so two sets' coordinates are equal with the probability of their
    Jaccard similarity.
    """
    best = np.full(n_rows * t, _EMPTY, np.uint64)
    base = row * t
    mask32 = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        h = seeded(elem, i)
        if i < t:
            at = base + (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
            free = best[at] == _EMPTY
            at, v = at[free], h[free] & mask32
        else:
            at = base + (i - t)
            free = best[at] == _EMPTY
            at, v = at[free], h[free] & mask32
        np.minimum.at(best, at, v | np.uint64(i << 32))
        if i % 4 == 3 or i < 3 or i >= t:
            open_rows = (best.reshape(n_rows, t) == _EMPTY).any(axis=1)
            if not open_rows.any():
                break
            keep = open_rows[row]
            if not keep.all():
                row, elem, base = row[keep], elem[keep], base[keep]
    return best.reshape(n_rows, t)


#: Counters of the order of elements: 2 ** SLOTS of them, in blocks of 2 ** SLOT_BLOCK.
SLOTS, SLOT_BLOCK = 24, 16
#: An id's place in the bitmap of wanted ids is its lowest bits.
WANTED_BITS = 25
#: Most characters whose elements are held at once beside the counters.
PART_CHARS = 500_000
#: Elements that a pair must share in its prefixes: MORE, and one for every MORE_PER words of the longer text.
MORE, MORE_PER = 2, 64


def codes_of(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, in steps of a tenth of a power of two; 0 stands for none and one, and none is lost above."""
    return np.minimum(np.floor(np.log2(np.maximum(counts, 1)) * 10), 255).astype(np.uint8)


def _rows_of(texts: list, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of the texts of enough words, their sizes, row among these of each element, elements)."""
    row, elem = bag_elements(texts, cache)
    size = np.bincount(row, minlength=len(texts))
    some = np.flatnonzero(size >= MIN_WORDS)
    keep = size[row] >= MIN_WORDS
    number = np.cumsum(size >= MIN_WORDS) - 1
    return some, size[some], number[row[keep]], elem[keep]


_KEYED = "id long, tag int, n int, k1 long, k2 long, block int, counts binary"


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    counts = np.zeros(1 << SLOTS, np.uint16)  # a task's counts stay at the most this holds: that moves nothing but the order
    names = [c.split()[0] for c in _KEYED.split(", ")]
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(2).to_numpy(zero_copy_only=False)
        for offset, texts in row_chunks(batch, 1, PART_CHARS):
            some, size, row, elem = _rows_of(texts, cache)
            if not len(some):
                continue
            slot, times = np.unique(elem >> np.uint64(64 - SLOTS), return_counts=True)
            counts[slot] = np.minimum(counts[slot] + times, 65535)
            starts = np.searchsorted(row, np.arange(len(some)))
            with np.errstate(over="ignore"):
                k1 = np.add.reduceat(elem, starts)
                k2 = np.add.reduceat(mix64(elem ^ np.uint64(0x5851F42D4C957F2D)), starts)
            none = [pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[offset + some], pa.int64()), pa.array(tags[offset + some], pa.int32()), pa.array(size, pa.int32()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *none], names=names)
    blocks = counts.reshape(-1, 1 << SLOT_BLOCK)
    for b in np.flatnonzero(blocks.any(axis=1)):
        one = pa.array([zlib.compress(blocks[b].tobytes(), 1)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([b], pa.int32()), one], names=names)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            total.setdefault(b, np.zeros(1 << SLOT_BLOCK, np.uint64))
            total[b] += np.frombuffer(zlib.decompress(packed.as_py()), np.uint16)
    for b, counts in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(codes_of(counts).tobytes(), 1)], pa.binary())], names=["block", "codes"])


def _plain(df: DataFrame, id_col: str, text_col: str, tag: Column | None) -> DataFrame:
    tag = F.lit(0) if tag is None else tag.cast("int")
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), tag.alias("tag")).where("id is not null and text is not null")


def keyed(df: DataFrame, id_col: str, text_col: str, tag: Column | None = None) -> tuple[DataFrame, dict[int, bytes]]:
    """(rows, order): id, tag (an int that goes along), n (words), k1 and k2 (128-bit key of the bag) of texts of enough words,
    and how often elements stand in these texts: counters by an element's hash, one byte each, so that the order has the
    same size (16 MB) whatever the input. Counters that elements share only make these seem more frequent.
    """
    both = stable(_plain(df, id_col, text_col, tag).mapInArrow(_key_batches, _KEYED))
    merged = both.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_merge_batches, "block int, codes binary")
    return both.where("block is null").drop("block", "counts"), {r.block: bytes(r.codes) for r in merged.collect()}


def need(longer: str) -> str:
    """SQL for the elements that a near-same pair shares in its prefixes at least."""
    return f"({MORE} + {longer} div {MORE_PER})"


_PREFIXED = "id long, tag int, n int, bits array<long>, grams array<long>, at array<int>"


def _prefix_batches(order: dict[int, bytes], block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    hot = int(codes_of(np.array([block + 1]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        codes = np.zeros((1 << SLOTS - SLOT_BLOCK, 1 << SLOT_BLOCK), np.uint8)
        for b, packed in order.items():
            codes[b] = np.frombuffer(zlib.decompress(packed), np.uint8)
        codes = codes.ravel()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(2).to_numpy(zero_copy_only=False)
            for offset, texts in row_chunks(batch, 1, PART_CHARS):
                some, size, row, elem = _rows_of(texts, cache)
                if not len(some):
                    continue
                n = len(some)
                words = 4 << np.maximum(np.ceil(np.log2(size / 192)), 0).astype(np.int64)  # 64-bit words of a row's bits
                begin = np.cumsum(words) - words
                bits = np.zeros(int(words.sum()), np.uint64)
                place = elem.astype(np.int64) & (64 * words[row] - 1)
                np.bitwise_xor.at(bits, begin[row] + (place >> 6), np.uint64(1) << (elem & np.uint64(63)))
                code = codes[(elem >> np.uint64(64 - SLOTS)).astype(np.int64)]
                # a stable sort: elements that agree in these bits stay in the order of their words, which is that of every row
                key = (row.astype(np.uint64) << np.uint64(52)) | (code.astype(np.uint64) << np.uint64(44)) | (elem >> np.uint64(20))
                o = np.argsort(key, kind="stable")
                row, elem, code = row[o], elem[o], code[o]
                at = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
                upto = size - np.ceil(SHARE * size).astype(np.int64) + MORE + 1 + size // MORE_PER
                keep = (at < upto[row]) & (code >= 10)
                keep &= (np.bincount(row[keep], minlength=n) >= MORE + size // MORE_PER)[row]  # fewer are in no pair
                count = np.bincount(row[keep], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[offset + some], pa.int64()),
                        pa.array(tags[offset + some], pa.int32()),
                        pa.array(size, pa.int32()),
                        list_column(bits.view(np.int64), words, pa.int64()),
                        list_column(elem[keep].view(np.int64), count, pa.int64()),
                        list_column((2 * at + (code >= hot))[keep].astype(np.int32), count, pa.int32()),
                    ],
                    names=["id", "tag", "n", "bits", "grams", "at"],
                )

    return run


def prefixed(df: DataFrame, id_col: str, text_col: str, order: dict[int, bytes], tag: Column | None = None, block: int = BLOCK) -> DataFrame:
    """id, tag, n, bits (parities of hashed elements), and the prefix of texts of enough words: grams and at.

    With elements in one order, the rarest first, two texts of a and b words of which the longer has m share k = SHARE * m
    elements at least, and the first j of these are among the first a - k + j and b - k + j of their texts. So texts meet by
    about a quarter of their elements, and no pair is lost, whatever the order is. Elements in no other text are left out.
    at: twice an element's place in the order, and one more if it may stand in more than ``block`` texts.
    """
    return _plain(df, id_col, text_col, tag).mapInArrow(_prefix_batches(order, block), _PREFIXED)


def places(prefixes: DataFrame) -> DataFrame:
    """bucket, at, id, tag, n: one row for each element of a prefix."""
    return prefixes.select("id", "tag", "n", F.expr("inline(arrays_zip(grams, at))")).withColumnRenamed("grams", "bucket")


def fits(a: str, b: str) -> str:
    """SQL: the lengths of a and b may be near-same."""
    return f"least({a}.n, {b}.n) >= {SHARE} * greatest({a}.n, {b}.n)"


def placed(a: str, b: str) -> str:
    """SQL: a place in a and one in b may be among the first shared ones of a near-same pair."""
    longer = f"greatest({a}.n, {b}.n)"
    return f"least({a}.n - {a}.at div 2, {b}.n - {b}.at div 2) + {need(longer)} - 1 >= {SHARE} * {longer}"


def apart(a: str, b: str) -> str:
    """SQL for the least number of elements in one of two texts only: the bits that differ, those of the longer folded."""
    fold = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
    return f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (p, q) -> bit_count(p ^ q)), 0, (u, v) -> u + v)"


def close(a: str, b: str) -> str:
    """SQL: bits of a and b (columns {a}n, {a}bits) leave open that they are near-same."""
    return f"{apart(f'{a}bits', f'{b}bits')} <= {a}n + {b}n - {2 * SHARE} * greatest({a}n, {b}n)"


def wanted_ids(ids: DataFrame) -> dict[int, bytes]:
    """A bitmap of the lowest bits of ids, 4 MB at most: other ids are met too, if these bits are the same."""
    low = F.expr(f"id & {(1 << WANTED_BITS) - 1}")
    rows = ids.select(low.alias("low")).groupBy(F.expr("shiftright(low, 15)").cast("int").alias("k")).agg(F.expr("bitmap_construct_agg(low & 32767)").alias("bits"))
    return {r.k: bytes(r.bits) for r in rows.collect()}


def _wanted_batches(wanted: dict[int, bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << WANTED_BITS - 15, 4096), np.uint8)
        for k, b in wanted.items():
            bits[k] = np.frombuffer(b, np.uint8)
        bits = bits.ravel()
        for batch in batches:
            low = batch.column(0).to_numpy(zero_copy_only=False) & ((1 << WANTED_BITS) - 1)
            yield batch.filter(pa.array((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1))

    return run


def only_wanted(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df (first column id) whose id is among ``ids``, and few others, without a shuffle of df."""
    return df.where("id is not null").mapInArrow(_wanted_batches(wanted_ids(ids)), df.schema)



def distinct_bits(ids: DataFrame) -> bool:
    """Whether no two ids have the same place in a bitmap of :func:`wanted_ids`."""
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    return low is None or high - low < 1 << WANTED_BITS


def _element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for offset, texts in row_chunks(batch, 1):
            row, elem = bag_elements(texts, cache)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(offset, len(texts)), list_column(elem.view(np.int64), np.bincount(row, minlength=len(texts)), pa.int64())],
                names=["id", "words"],
            )


def elements(df: DataFrame) -> DataFrame:
    """(id, text) -> (id, words): each bag as an array of hashed (word, occurrence) elements without repeats."""
    return df.select("id", "text").mapInArrow(_element_batches, "id long, words array<long>")


def counted(pairs: DataFrame, by: tuple[str, str], longer: str = "longer") -> DataFrame:
    """Pairs of ids that meet in as many places as near-same ones do, once each."""
    return pairs.groupBy(*by).agg(F.count("*").alias("met"), F.first(longer).alias(longer)).where(f"met >= {need(longer)}").drop("met")


def bucket_pairs(banded: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of ids that share a bucket and fit in length; with places, (a, b, longer) of those that meet often enough.

    banded: bucket, id, n, and for places at. Buckets of more than ``block`` ids are cut into blocks, and the pairs of
    blocks spread over tasks, so that a hot bucket is neither dropped nor met by one task. The filters are part of the join.
    """
    with_places = "at" in banded.columns
    near = f"{fits('x', 'y')} and {placed('x', 'y')}" if with_places else fits("x", "y")
    hot = banded.where("at % 2 = 1") if with_places else banded
    hot = stable(hot.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("g")))
    pair = lambda df: df.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b"), F.expr("greatest(x.n, y.n)").alias("longer"))
    meet = lambda df: pair(df.alias("x").join(df.alias("y"), F.expr(f"x.bucket = y.bucket and x.id < y.id and {near}")))
    if not hot.take(1):
        met = meet(banded)
    else:  # apart from the others, which are shuffled once for both sides
        few = F.broadcast(hot) if small_enough(hot) else hot
        tagged = banded.join(few, "bucket").withColumn("cut", F.expr("cast(pmod(hash(id, 11), g) as int)"))
        x = tagged.withColumn("other", F.explode(F.expr("sequence(cut, g - 1)"))).withColumn("cell", F.expr("struct(cut as at, other)"))
        y = tagged.withColumn("other", F.explode(F.expr("sequence(0, cut)"))).withColumn("cell", F.expr("struct(other as at, cut as other)"))
        grid = x.alias("x").join(y.alias("y"), F.expr(f"x.bucket = y.bucket and x.cell = y.cell and (x.id < y.id or (x.cut <> y.cut and x.id <> y.id)) and {near}"))
        met = meet(banded.join(few, "bucket", "left_anti")).unionByName(pair(grid))
    return counted(met, ("a", "b")) if with_places else met.select("a", "b").distinct()


def classes(sk: DataFrame) -> DataFrame:
    """id, rep: the smallest id with the same bag of words."""
    rep = sk.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    return sk.select("id", "k1", "k2").join(rep, ["k1", "k2"]).select("id", "rep")


def links(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, links): every text of enough words with its class, and the near-same pairs of classes (a < b).

    links has the exact number of shared words; it was tested on whole texts.
    """
    sk, order = keyed(df, id_col, text_col)
    members = stable(classes(sk))
    reps = members.where("id = rep").select("id")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prefixes = prefixed(only_wanted(texts, reps), "id", "text", order)
    if not distinct_bits(members):
        prefixes = prefixes.join(reps, "id", "left_semi")
    prefixes = stable(prefixes)
    near = bucket_pairs(places(prefixes))
    side = lambda as_: prefixes.select(F.col("id").alias(as_), F.col("n").alias(f"{as_}n"), F.col("bits").alias(f"{as_}bits"))
    near = stable(near.join(side("a"), "a").join(side("b"), "b").where(close("a", "b")).select("a", "b", "longer"))
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    words = stable(elements(only_wanted(texts, wanted)))
    found = (
        near.join(words.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        .join(words.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        .select("a", "b", "longer", F.size(F.array_intersect("wa", "wb")).alias("shared"))
        .where(F.col("shared") >= SHARE * F.col("longer"))
    )
    return members, found


def expand(members: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every pair of rows of one class or of two linked classes.

    Classes are cut into blocks of about ``block`` rows, and pairs of blocks are what tasks work on, so that no class,
    however many copies it has, is expanded by one task.
    """
    size = members.groupBy("rep").agg(F.ceil(F.count("*") / block).cast("int").alias("g"), (F.count("*") > 1).alias("many"))
    m = stable(members.join(size, "rep").withColumn("at", F.expr("cast(pmod(hash(id, 13), g) as int)")))
    shared = m.where("many")
    x = shared.withColumn("other", F.explode(F.expr("sequence(at, g - 1)"))).withColumn("cell", F.expr("struct(at, other)"))
    y = shared.withColumn("other", F.explode(F.expr("sequence(0, at)"))).withColumn("cell", F.expr("struct(other as at, at as other)"))
    same = x.alias("x").join(y.alias("y"), F.expr("x.rep = y.rep and x.cell = y.cell and (x.id < y.id or (x.at <> y.at and x.id <> y.id))"))
    same = same.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b"))
    blocks = lambda as_: size.select(F.col("rep").alias(as_), F.explode(F.expr("sequence(0, g - 1)")).alias(f"{as_}_at"))
    side = lambda as_: m.select(F.col("rep").alias(as_), F.col("at").alias(f"{as_}_at"), F.col("id").alias(f"i{as_}"))
    cells = found.select("a", "b").join(blocks("a"), "a").join(blocks("b"), "b")
    cross = cells.join(side("a"), ["a", "a_at"]).join(side("b"), ["b", "b_at"]).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
    return same.unionByName(cross)


def near_pairs(df: DataFrame, id_col: str = "sample_id", text_col: str = "tool_output") -> DataFrame:
    """sample_id_a < sample_id_b of all near-same pairs, copies expanded."""
    members, found = links(df, id_col, text_col)
    return expand(members, stable(found)).select(F.col("a").alias(f"{id_col}_a"), F.col("b").alias(f"{id_col}_b"))
