"""Hooks for models: a scorer gives every line of an observation a probability; the engine does the rest.

A scorer is a factory, called once a worker process, of a function (query, lines) -> probabilities. Extraction keeps
lines from a threshold on; the token layouts and examples are those of the models that may be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cumulative
from ..runtime import ranked
from .dataset import order_key
from .windows import greedy

Scorer = Callable[[str, list[str]], list[float]]

THRESHOLD = 0.5
#: Label of tokens that are no target.
IGNORE = -100


def word_scorer() -> Scorer:
    """The scorer without a model: share of the query's words in the line."""

    def score(query: str, lines: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(x.lower().split())) / max(1, len(asked)) for x in lines]

    return score


def line_scores(df: DataFrame, factory: Callable[[], Scorer] = word_scorer) -> DataFrame:
    """id, scores (one a line) of observations (id, text, query); null text or query counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "scores": [list(map(float, scorer(q or "", (t or "").split("\n")))) for q, t in zip(pdf["query"], pdf.text)]})

    return df.select("id", "text", "query").mapInPandas(run, f"id {dict(df.dtypes)['id']}, scores array<double>")


def over_threshold(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id, line_no, score of the lines that are kept."""
    return scored.select("id", F.posexplode("scores").alias("i", "score")).where(F.col("score") >= threshold).select("id", (F.col("i") + 1).alias("line_no"), "score")


def pooled(windows: DataFrame) -> DataFrame:
    """id, line_no, score: the best of a line's scores over all windows and chunks that hold it, 0 at least.

    windows: id, line_no, score, one row a line, window and chunk.
    """
    return windows.groupBy("id", "line_no").agg(F.greatest(F.lit(0.0), F.max("score")).alias("score"))


def extract_many(df: DataFrame, factory: Callable[[], Scorer] = word_scorer, threshold: float = THRESHOLD) -> DataFrame:
    """id, kept_text of every observation, in one pass; ids keep the order of the input apart from the partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for pdf in batches:
            kept = []
            for query, text in zip(pdf["query"], pdf.text):
                lines = (text or "").split("\n")
                kept.append("\n".join([x for x, s in zip(lines, scorer(query or "", lines)) if s >= threshold]))
            yield pd.DataFrame({"id": pdf.id, "kept_text": kept})

    return df.select("id", "text", "query").mapInPandas(run, f"id {dict(df.dtypes)['id']}, kept_text string")


def model_input(task: Column, lines: Column, cls: int, sep: int, line_sep: int, most: int) -> Column:
    """[CLS] task [SEP] line [LINE_SEP] line ... [SEP] from token ids, cut at ``most``."""
    one = lambda x: F.array(F.lit(x))
    body = F.flatten(F.transform(lines, lambda x, i: F.when(i > 0, F.concat(one(line_sep), x)).otherwise(x)))
    return F.slice(F.concat(one(cls), task, one(sep), body, one(sep)), 1, most)


def masked_labels(prompt: Column, response: Column) -> Column:
    """Labels of prompt and response tokens: those of the prompt are ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), response)


def padded(ids: Column, to: Column, fill: int, left: bool) -> Column:
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), to - F.size(ids)))
    return F.concat(pad, ids) if left else F.concat(ids, pad)


def class_weight(positives: Column, negatives: Column) -> Column:
    """Weight of positive targets, ten at most; null if either class is empty."""
    return F.when((positives > 0) & (negatives > 0), F.least(negatives / positives, F.lit(10.0)))


def balanced(windows: DataFrame, share: float = 0.5, seed: int = 42) -> DataFrame:
    """All positive windows and, by hashed order, as many negative ones as make ``share`` of the result.

    windows: key, positive. The cut is a hash threshold found from counts in 65,536 steps, then a rank inside the last
    step; there is no sort of all windows.
    """
    n = windows.where("positive").count()
    room = int(n * share / (1 - share))
    hashed = windows.where("not positive").withColumn("_h", order_key(seed, F.col("key"))).withColumn("_s", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    upto, last, left = 0, None, 0
    for r in sorted(hashed.groupBy("_s").count().collect()):  # at most 65,536 numbers
        if upto + r["count"] > room:
            last, left = r["_s"], room - upto
            break
        upto += r["count"]
    if last is None:
        kept = hashed
    else:
        edge = ranked(hashed.where(F.col("_s") == last), F.col("_h"), F.col("key"), name="_r").where(F.col("_r") < left).drop("_r")
        kept = hashed.where(F.col("_s") < last).unionByName(edge)
    return windows.where("positive").unionByName(kept.drop("_h", "_s"))


def segments(tokens: Column, separator: int) -> Column:
    """Segment of each token: how many separators stand up to it. A separator opens its segment."""
    return F.slice(cumulative(F.transform(tokens, lambda t: (t == separator).cast("int"))), F.lit(2), F.size(tokens))


def pooled_segments(df: DataFrame, separator: int) -> DataFrame:
    """id, segment, best and mean of the scores of a segment's tokens, separators left out.

    df: id, tokens (array<int>), scores (array<double>, one a token); segments without a token have no row.
    """
    flat = df.select("id", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("scores").alias("score"), segments(F.col("tokens"), separator).alias("segment")))).toDF("id", "token", "score", "segment")
    return flat.where(F.col("token") != separator).groupBy("id", "segment").agg(F.max("score").alias("best"), F.avg("score").alias("mean"))


#: (query, text) -> half-open spans of code points.
Highlighter = Callable[[str, str], list[tuple[int, int]]]


def word_highlighter() -> Highlighter:
    """The highlighter without a model: the first place of each of the query's words, in any case."""

    def find(query: str, text: str) -> list[tuple[int, int]]:
        low = text.lower()
        at = [(low.find(w), len(w)) for w in set(query.lower().split())]
        return [(a, a + n) for a, n in at if a >= 0]

    return find


def highlighted(df: DataFrame, factory: Callable[[], Highlighter] = word_highlighter) -> DataFrame:
    """id, line_no, line: filled lines that a span of a highlighter touches. Observations: id, text, query; null counts as empty.

    A span touches a line unless it ends at or before the line's start or begins at or after its end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = factory()
        for pdf in batches:
            out = []
            for i, query, text in zip(pdf.id, pdf["query"], pdf.text):
                lines = (text or "").split("\n")
                stops = np.cumsum([len(x) + 1 for x in lines]) - 1
                starts = np.append(0, stops[:-1] + 1)
                kept = np.zeros(len(lines), bool)
                for a, b in find(query or "", text or ""):
                    kept |= (starts < b) & (stops > a)
                out += [(i, k + 1, lines[k]) for k in np.flatnonzero(kept) if lines[k].strip()]
            yield pd.DataFrame(out, columns=["id", "line_no", "line"])

    return df.select("id", "text", "query").mapInPandas(run, f"id {dict(df.dtypes)['id']}, line_no int, line string")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; the largest is taken off first, so none overflows."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def line_examples(df: DataFrame, cls: int, sep: int, line_sep: int, most: int, budget: int) -> DataFrame:
    """Training examples of observations: id, window (from 0), input_ids, attention, line_labels.

    df: id, task (array<int>), lines (array<array<int>>, token ids of each line), labels (array<int>, one a line). Lines go
    into greedy windows of ``budget`` tokens; windows of empty lines only are left out.
    """
    wins = greedy(F.transform("lines", F.size), budget)
    rows = df.withColumn("_w", wins).select("id", "task", "lines", "labels", F.posexplode("_w").alias("window", "_w"))
    part = lambda c: F.slice(c, F.col("_w.first") + 1, F.col("_w.stop") - F.col("_w.first"))
    rows = rows.withColumns({"_lines": part("lines"), "line_labels": part("labels")}).where(F.exists("_lines", lambda x: F.size(x) > 0))
    rows = rows.withColumn("input_ids", model_input(F.col("task"), F.col("_lines"), cls, sep, line_sep, most))
    return rows.select("id", "window", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention"), "line_labels")
