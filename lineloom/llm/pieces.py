"""Oversized texts cut at natural boundaries, with overlap (problem 5).

One regular expression cuts a text into steps that follow each other. Its alternatives stand in order of boundary
strength, each with a bounded quantifier that takes as much as fits: the rest of the text, up to a blank line, up to a
line end, up to a sentence end, up to white space, and any character that leaves combining marks with their base. A
step is at most ``max_chars - overlap_chars`` long; a piece is a step and what is looked back to before it: at least
``overlap_chars``, and up to as much again if a line starts there. So pieces are within the limit, consecutive ones
share at least the overlap, and together they are the text.

All is done with array functions inside one row; nothing is shuffled. What stands before a step is taken from the steps
before it, never from the whole text, so the cost of a text is in proportion to its length; only lengths leave the JVM. Lengths are code points. A gold line counts as
held by a piece if the piece has all of it. Null and empty texts, and those within their limit, give no piece. A limit
not above the overlap is an error. Limits are looked up by tool type, null being any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cumulative, first_within
from ..functions.let import let
from ..operators import spans as S


def cut_pattern(max_chars: int, overlap: int) -> str:
    """The step pattern for one limit."""
    c = max_chars - overlap
    if c <= 0 or max_chars <= 0 or overlap < 0:
        raise ValueError(f"limit {max_chars} must exceed overlap {overlap}")
    half, low = max(1, c // 2), min(c, overlap + 1)
    return (
        rf"(?s).{{1,{c}}}\z"
        rf"|.{{{max(half, low)},{c}}}(?<=\n\r?\n)"
        rf"|.{{{low},{c}}}(?<=\n)"
        rf"|(?!\A).{{1,{c}}}(?<=\n)"
        rf"|.{{{max(half, low)},{c}}}(?<=[.!?;。！？][ \t])"
        rf"|.{{{max(half, low)},{c}}}(?<=\s)"
        rf"|.{{{low},{c}}}(?![\p{{M}}\x{{200D}}\n])"
        rf"|.{{1,{c}}}"
    )


def _limits(df: DataFrame, tool_col: str, limits: list[tuple[str | None, int, int]]) -> tuple[Column, Column, Column]:
    """(max_chars, overlap_chars, pattern) of each row, null without a limit."""
    named = [x for x in limits if x[0] is not None]
    other = next((x for x in limits if x[0] is None), None)

    def pick(value) -> Column:
        out = None
        for x in named:
            out = F.when(F.col(tool_col) == x[0], F.lit(value(x))) if out is None else out.when(F.col(tool_col) == x[0], F.lit(value(x)))
        last = F.lit(value(other)) if other else F.lit(None)
        return last if out is None else out.otherwise(last)

    return pick(lambda x: int(x[1])), pick(lambda x: int(x[2])), pick(lambda x: cut_pattern(int(x[1]), int(x[2])))


def pieces(df: DataFrame, limits: DataFrame, id_col: str = "sample_id", text_col: str = "tool_output", tool_col: str = "tool_type", spans_col: str = "gold_spans") -> DataFrame:
    """id, piece (from 0), start and end (half-open, code points), first_line, last_line, piece_text,
    gold (spans of gold lines the piece holds whole) and gold_cut (gold lines it holds in part)."""
    rules = [(r.tool_type, r.max_chars, r.overlap_chars) for r in limits.select("tool_type", "max_chars", "overlap_chars").distinct().collect()]  # a fixed table
    if not rules:
        rules = [(None, 2**31 - 1, 0)]
    most, overlap, pattern = _limits(df, tool_col, rules)
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"), F.col(tool_col), F.col(spans_col).alias("spans")).withColumns({"most": most, "overlap": overlap}).where(F.length("text") > F.col("most"))
    rows = rows.select(id_col, "text", "most", "overlap", S.normalise(F.col("spans"), S.n_lines(F.col("text"))).alias("spans"), F.expr("length(text)").alias("n"), F.regexp_extract_all("text", pattern, 0).alias("steps"))
    newlines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    rows = rows.withColumns({"ends": cumulative(F.transform("steps", F.length)), "before": cumulative(F.transform("steps", newlines))})
    rows = rows.withColumn("firsts", first_within(F.col("ends"), 2 * F.col("overlap") + 1)).drop("text")

    def place(i: Column) -> Column:
        first = F.get("firsts", i)
        return let(look_back, i=i, step=F.get("ends", i).cast("int"), end=F.get("ends", i + 1).cast("int"), own=F.get("steps", i), origin=F.get("ends", first).cast("int"), back=F.array_join(F.slice("steps", first + 1, i - first), ""))

    def look_back(v: Column) -> Column:
        """The earliest start that keeps the limit and looks back at most twice the overlap, at a line's start if there is one."""
        low = F.when(v["i"] == 0, 0).otherwise(F.greatest(F.lit(0), v["end"] - F.col("most"), v["step"] - 2 * F.col("overlap")))
        high = F.when(v["i"] == 0, 0).otherwise(F.greatest(F.lit(0), v["step"] - F.col("overlap")))
        return let(lambda w: with_start(v, w), high=high, at=F.instr(F.reverse(F.substring(v["back"], low - v["origin"] + 1, high - low)), "\n"))

    def with_start(v: Column, w: Column) -> Column:
        start = F.when(w["at"] > 0, w["high"] - w["at"] + 1).otherwise(w["high"])
        return let(lambda x: with_lead(v, x), start=start, lead=F.substring(v["back"], start - v["origin"] + 1, v["step"] - start))

    def with_lead(v: Column, x: Column) -> Column:
        line = (1 + F.get("before", v["i"]) - newlines(x["lead"])).cast("int")
        return let(lambda y: finish(v, x, y), text=F.concat(x["lead"], v["own"]), first=line)

    def finish(v: Column, x: Column, y: Column) -> Column:
        last = y["first"] + newlines(y["text"]) - y["text"].endswith("\n").cast("int")
        whole_first = (x["start"] == 0) | (F.substring(v["back"], x["start"] - v["origin"], F.lit(1)) == "\n")
        whole_last = (v["end"] == F.col("n")) | y["text"].endswith("\n") | F.coalesce(F.get("steps", v["i"] + 1).startswith("\n"), F.lit(False))
        a = F.when(whole_first, y["first"]).otherwise(y["first"] + 1)
        b = F.when(whole_last, last).otherwise(last - 1)
        return F.struct(
            v["i"].alias("piece"), x["start"].alias("start"), v["end"].alias("end"), y["first"].alias("first_line"), last.alias("last_line"), y["text"].alias("piece_text"),
            S.within(F.col("spans"), a, b).alias("gold"), S.covered_lines(S.within(F.col("spans"), y["first"], last)).alias("touched"),
        )

    rows = rows.select(id_col, F.inline(F.transform(F.sequence(F.lit(0), F.size("steps") - 1), place)))
    return rows.select(id_col, "piece", "start", "end", "first_line", "last_line", "piece_text", "gold", (F.col("touched") - S.covered_lines(F.col("gold"))).alias("gold_cut"))
