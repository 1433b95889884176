"""Line spans: arrays of (start_line, end_line), 1-based and inclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start_line:int,end_line:int>>"


def n_lines(text: Column) -> Column:
    """Lines of a text, split at newlines; the empty text has one line, null none (null)."""
    return F.size(F.split(text, "\n", -1))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))


def normalise(spans: Column, lines: Column) -> Column:
    """Clamped to 1..lines, sorted, overlapping and adjacent spans merged; spans that are empty after clamping go.

    Null spans, and spans with a null end, count as absent; the result is never null unless ``lines`` is.
    """
    known = F.filter(F.coalesce(spans, F.from_json(F.lit("[]"), SPANS)), lambda s: s["start_line"].isNotNull() & s["end_line"].isNotNull())
    clamped = F.transform(known, lambda s: _span(F.greatest(F.lit(1), s["start_line"]), F.least(lines, s["end_line"])))
    kept = F.sort_array(F.filter(clamped, lambda s: s["start_line"] <= s["end_line"]))
    start = F.filter(kept, lambda s: F.lit(False)).cast(SPANS)

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (s["start_line"] <= last["end_line"] + 1)
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(_span(last["start_line"], F.greatest(last["end_line"], s["end_line"]))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(_span(s["start_line"], s["end_line"])))).cast(SPANS)

    return F.aggregate(kept.cast(SPANS), start, step)


def covered_lines(spans: Column) -> Column:
    """Sum of the lengths of raw spans; overlaps count twice."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end_line"] - s["start_line"] + 1).cast("long"))


def extract(text: Column, spans: Column) -> Column:
    """The lines of normalised spans, as an array."""
    lines = F.split(text, "\n", -1)
    return F.flatten(F.transform(spans, lambda s: F.slice(lines, s["start_line"], s["end_line"] - s["start_line"] + 1)))


def within(spans: Column, first: Column, last: Column) -> Column:
    """The parts of normalised spans between two lines, both included."""
    met = F.filter(spans, lambda s: (s["start_line"] <= last) & (s["end_line"] >= first))
    return F.transform(met, lambda s: _span(F.greatest(s["start_line"], first), F.least(s["end_line"], last)))
