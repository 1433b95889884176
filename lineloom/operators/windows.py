"""Token budgets: chunks of lines, overlapping windows, and scores pooled back to lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.let import let

OVERLAP = 2
WINDOWS = "array<struct<first:int,stop:int>>"


def chunks(sizes: Column, most: int) -> Column:
    """(line, size) of the pieces of lines of ``sizes`` tokens: none for an empty line, a line over ``most`` in parts."""
    def one(n: Column, i: Column) -> Column:
        parts = F.when(n > 0, F.sequence(F.lit(1), F.ceil(n / most).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(parts, lambda k: F.struct(i.alias("line"), F.least(F.lit(most), n - (k - 1) * most).cast("int").alias("size")))

    return F.flatten(F.transform(sizes, one))


def greedy(sizes: Column, budget: int, overlap: int = OVERLAP, drop_redundant: bool = False) -> Column:
    """Windows [first, stop) over consecutive items that cost their size and one separator between two.

    Each takes as many items as fit, at least one; the next begins ``overlap`` items before its end, but later than the
    one before. So a window of three or more items at the end is followed by short ones inside it, unless
    ``drop_redundant``. No items: no window. One pass, written as a fold: the state is the open window and its cost.
    """
    n = F.size(sizes)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(WINDOWS).alias("out"))

    def reach(first: Column) -> Column:
        run = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("taken"), F.lit(False).alias("full"))

        def take(a: Column, x: Column) -> Column:
            cost = F.when(a["taken"] == 0, x.cast("long")).otherwise(a["used"] + 1 + x)
            fits = ~a["full"] & ((a["taken"] == 0) | (cost <= budget))
            return F.struct(F.when(fits, cost).otherwise(a["used"]).alias("used"), F.when(fits, a["taken"] + 1).otherwise(a["taken"]).alias("taken"), (~fits).alias("full"))

        # an item and its separator cost one at least, so no window has more than budget + 1 items
        return first + F.aggregate(F.slice(sizes, first + 1, budget + 1), run, take, lambda a: a["taken"])

    def step(a: Column, _: Column) -> Column:
        return F.when(a["at"] >= n, a).otherwise(let(lambda e: grow(a, e["end"]), end=reach(a["at"])))

    def grow(a: Column, end: Column) -> Column:
        stop = F.when(F.lit(drop_redundant) & (end >= n), n).otherwise(F.greatest(a["at"] + 1, end - overlap))
        return F.struct(stop.alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("first"), end.alias("stop"))).cast(WINDOWS).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])
