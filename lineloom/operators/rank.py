"""Pruners: (text, query) -> numbers of the kept lines. A registry lets other pruners be named beside them."""

from __future__ import annotations

import bisect
import heapq
import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Share of lines kept, at least one line.
RATIO = 0.1

Pruner = Callable[[DataFrame], DataFrame]
PRUNERS: dict[str, Pruner] = {}


def pruner(name: str) -> Callable[[Pruner], Pruner]:
    """Registers a function that adds ``kept`` (array<int>, ascending) to a table with text and query."""

    def add(f: Pruner) -> Pruner:
        PRUNERS[name] = f
        return f

    return add


def budget(n: Column) -> Column:
    return F.greatest(F.lit(1), (n.cast("double") * F.lit(RATIO)).cast("int"))


def _n() -> Column:
    return F.size(X.lines(F.col("text")))


@pruner("first")
def first(df: DataFrame) -> DataFrame:
    return df.withColumn("kept", F.sequence(F.lit(1), budget(_n())))


@pruner("last")
def last(df: DataFrame) -> DataFrame:
    return df.withColumn("kept", F.sequence(_n() - budget(_n()) + 1, _n()))


@pruner("hash")
def hashed(df: DataFrame) -> DataFrame:
    """Lines of smallest md5 of seed, id and line number: a sample of fixed size that needs no random state."""
    ranked = F.transform(F.sequence(F.lit(1), _n()), lambda i: F.struct(F.md5(F.concat_ws("|", F.lit("42"), F.col("id").cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    return df.withColumn("kept", F.sort_array(F.transform(F.slice(F.sort_array(ranked), 1, budget(_n())), lambda s: s["i"])))


def bm25_lines(text: str, query: str, k1: float, b: float) -> list[int]:
    """Numbers of the lines of highest BM25 of a lower-cased text; see :func:`bm25`."""
    words = [x.split() for x in text.split("\n")]
    n = len(words)
    terms = sorted(set(query.split()))
    avg = max(sum(map(len, words)) / n, 1.0)
    asked = set(terms)
    hits = [(i, Counter(t for t in w if t in asked)) for i, w in enumerate(words) if not asked.isdisjoint(w)]
    df = Counter(t for _, c in hits for t in c)
    idf = {t: math.log((n - d + 0.5) / (d + 0.5) + 1.0) for t, d in df.items()}
    score = [(0.0, i) for i in range(n)]
    for i, c in hits:
        norm = k1 * ((1 - b) + b * len(words[i]) / avg)
        total = 0.0
        for t in terms:
            if t in c:
                total += idf[t] * (c[t] * (k1 + 1) / (c[t] + norm))
        score[i] = (round(total, 9), i)
    return sorted(i + 1 for _, i in heapq.nlargest(max(1, int(n * RATIO)), score))


@pruner("bm25")
def bm25(df: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Lines of highest BM25 against the query's distinct words; of equal scores the later line wins.

    One Arrow pass over text and query, in time in proportion to the text; null text or query gives null.
    """

    @F.pandas_udf("array<int>")
    def run(text: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([bm25_lines(t, q, k1, b) if t is not None and q is not None else None for t, q in zip(text, query)], dtype=object)

    return df.withColumn("kept", run(F.lower("text"), F.lower("query")))


def islands(kept: Column) -> Column:
    """Sorted distinct line numbers as maximal runs (start_line, end_line)."""
    from .spans import normalise

    return normalise(F.transform(kept, lambda i: F.struct(i.alias("start_line"), i.alias("end_line"))), F.lit(2**31 - 2))


def kept_lines(text: Column, kept: Column) -> Column:
    return F.transform(kept, lambda i: F.get(X.lines(text), i - 1))


def matching_lines(lines: list[str], refs: list[str]) -> list[int]:
    """Numbers of filled lines that equal, hold or stand in one of ``refs``; white space is squashed on both sides."""
    flat = {r for x in refs if (r := " ".join(x.split()))}
    if not flat:
        return []
    whole = "\n".join(flat)
    by_size = sorted(flat, key=len)
    sizes = [len(r) for r in by_size]
    seen: dict[str, bool] = {}
    out = []
    for i, line in enumerate(lines, 1):
        x = " ".join(line.split())
        if not x:
            continue
        if (hit := seen.get(x)) is None:
            hit = seen[x] = x in flat or x in whole or any(r in x for r in by_size[: bisect.bisect_left(sizes, len(x))])
        if hit:
            out.append(i)
    return out


def matched(text: Column, refs: Column) -> Column:
    """Line numbers (array<int>) of a text that match reference lines, by :func:`matching_lines`."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series, sets: pd.Series) -> pd.Series:
        return pd.Series([matching_lines(t.split("\n"), list(r)) if t is not None and r is not None else None for t, r in zip(texts, sets)], dtype=object)

    return run(text, refs)
