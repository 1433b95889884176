"""Texts as ordered lines. Everything works inside a row; only ``explode`` makes one row a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import cumulative


def explode(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep..., line_no (from 1), line."""
    return df.select(*keep, F.posexplode(X.lines(F.col(text_col))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def offsets(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep..., line_no, line, start and stop (half-open code points of the text)."""
    rows = df.select(*keep, X.lines(F.col(text_col)).alias("_lines"))
    rows = rows.withColumn("_starts", cumulative(F.transform("_lines", lambda x: F.length(x) + 1)))
    rows = rows.select(*keep, F.posexplode(F.arrays_zip("_lines", "_starts")).alias("_i", "_z")).where("_z._lines is not null")
    start = F.col("_z._starts").cast("int")
    return rows.select(*keep, (F.col("_i") + 1).alias("line_no"), F.col("_z._lines").alias("line"), start.alias("start"), (start + F.length("_z._lines")).alias("stop"))


def numbered(text: Column) -> Column:
    """Lines as '1: ...'."""
    return F.array_join(F.transform(X.lines(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` lines and a note on the rest."""
    n = F.size(X.lines(text))
    note = F.concat(F.lit("... ("), (n - most).cast("string"), F.lit(" more lines omitted)"))
    return F.when(n > most, F.array_join(F.concat(F.slice(X.lines(text), 1, most), F.array(note)), "\n")).otherwise(text)


def bounded_view(text: Column, most_lines: int = 500, line_chars: int = 400, total_chars: int = 60_000) -> Column:
    """Numbered lines under three budgets; the first line over the total ends the view, notes tell what is missing."""
    all_ = X.lines(text)
    cut = F.transform(
        F.slice(all_, 1, most_lines),
        lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.when(F.length(x) > line_chars, F.concat(F.substring(x, 1, line_chars), F.lit(" ... [truncated for prompt]"))).otherwise(x)),
    )
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).alias("done"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        size = a["chars"] + F.length(x).cast("long") + 1
        fits = ~a["full"] & (size <= total_chars)
        return F.struct(F.when(fits, size).otherwise(a["chars"]).alias("chars"), F.when(fits, a["done"] + 1).otherwise(a["done"]).alias("done"), (a["full"] | ~fits).alias("full"))

    def finish(a: Column) -> Column:
        done = a["done"]
        full = F.when(a["full"], F.array(F.concat((done + 1).cast("string"), F.lit(f": ... [prompt view truncated at {total_chars} chars]")))).otherwise(F.array().cast("array<string>"))
        left = F.size(all_) - done
        rest = F.when(left > 0, F.array(F.concat((done + 1).cast("string"), F.lit(": ... ["), left.cast("string"), F.lit(" lines omitted for prompt]")))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.slice(cut, 1, done), full, rest), "\n")

    return F.aggregate(cut, start, step, finish)


def kept_text(text: Column, spans: Column) -> Column:
    """The lines of normalised spans, with notes on how many lines were left out before, between and after them."""
    all_ = X.lines(text)
    note = lambda n: F.concat(F.lit("... ("), n.cast("string"), F.lit(" lines omitted)"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = s["start_line"] - a["at"] - 1
        body = F.slice(all_, s["start_line"], s["end_line"] - s["start_line"] + 1)
        return F.struct(s["end_line"].alias("at"), F.concat(a["out"], F.when(gap > 0, F.array(note(gap))).otherwise(none), body).alias("out"))

    def finish(a: Column) -> Column:
        left = F.size(all_) - a["at"]
        return F.when(a["at"] == 0, F.lit("")).otherwise(F.array_join(F.concat(a["out"], F.when(left > 0, F.array(note(left))).otherwise(none)), "\n"))

    return F.aggregate(spans, start, step, finish)
