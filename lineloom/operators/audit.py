"""Audits of rows: issue codes, counts, and the checks they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import dataset as D
from . import spans as S

#: What a query about a tool may not ask for.
FORBIDDEN = {
    "type_check": ("class definition", "function definition", "method definition", "import statement"),
    "python": ("class definition", "function definition", "method definition", "import statement"),
    "pip_install": ("class definition", "function definition", "method definition", "import statement"),
    "build_output": ("class definition", "function definition", "method definition", "import statement"),
    "test_output": ("class definition", "function definition", "method definition", "import statement"),
    "ls": ("traceback", "error block", "class definition", "function definition", "read the code", "code block", "implementation of"),
    "git_log": ("class definition", "function definition", "import statement"),
}


def compatible(tool: Column, query: Column) -> Column:
    """Whether a query asks for something the tool's output can hold."""
    q = F.lower(X.strip(query))
    bad = (q == "") | q.contains("all lines containing") | (q.startswith("find the import statement") & (tool != "read_file"))
    for kind, markers in FORBIDDEN.items():
        hit = F.lit(False)
        for m in markers:
            hit = hit | q.contains(m)
        bad = bad | ((tool == kind) & hit)
    named = q.contains("class") | q.contains("function") | q.contains("method") | q.contains("import")
    return ~(bad | (tool.isin("type_check", "python", "build_output", "pip_install", "test_output") & q.contains("code block") & named))


def missing_lines(text: Column, lines: Column) -> Column:
    """Filled lines that are not in the text, neither as they are nor with white space squashed."""
    flat = X.squash(text)
    return F.filter(lines, lambda x: ~X.is_blank(x) & ~text.contains(x) & ~flat.contains(X.squash(x)))


def in_order(text: Column, lines: Column) -> Column:
    """Whether filled lines that are in the text as they are stand one after the other in it; blank and missing ones don't count."""

    def step(at: Column, x: Column) -> Column:
        pos = F.call_function("locate", x, text, at)
        after = F.when(pos > 0, pos + F.length(x)).when(text.contains(x), F.lit(0)).otherwise(at)
        return F.when((at == 0) | X.is_blank(x), at).otherwise(after)

    return F.aggregate(lines, F.lit(1), step) != 0


def duplicates(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def check_lines(query: Column, text: Column, lines: Column, placed: bool = True) -> dict[str, Column]:
    """issues (array of codes), n_output_lines (filled ones), n_relevant_lines, duplicate_count of lines chosen from a text.

    Without ``placed`` it is not checked that the lines are in the text, in order.
    """
    filled = F.size(F.filter(X.lines(text), lambda x: ~X.is_blank(x)))
    rel, dup = F.size(lines), duplicates(lines)
    issue = lambda when, code: F.when(when, F.lit(code))
    missing = F.size(missing_lines(text, lines))
    there = [issue(missing > 0, "relevant_lines_missing"), issue((missing == 0) & ~in_order(text, lines), "relevant_lines_out_of_order")] if placed else []
    issues = F.array(
        issue(F.length(F.coalesce(query, F.lit(""))) < 10, "task_too_short"),
        issue(F.length(F.coalesce(text, F.lit(""))) < 20, "tool_output_too_short"),
        *there,
        issue(dup > 0, "duplicate_relevant_lines"),
        issue((filled > 0) & (rel > 0) & (rel / F.greatest(filled, F.lit(1)) > 0.5), "high_relevant_ratio"),
    )
    return {"issues": F.array_compact(issues), "n_output_lines": filled.cast("long"), "n_relevant_lines": rel.cast("long"), "duplicate_count": dup}


def audit(df: DataFrame) -> DataFrame:
    """sample_id, tool_type, status, issues (array of codes), n_output_lines, n_relevant_lines, duplicate_count.

    Relevant lines are those of the normalised spans, so none can be missing or out of order; spans that are not
    normalised are an issue of their own.
    """
    rows = df.withColumn("_normal", S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output"))))
    rows = rows.withColumn("_lines", S.extract(F.col("tool_output"), F.col("_normal")))
    got = check_lines(F.col("query"), F.col("tool_output"), F.col("_lines"), placed=False)
    odd = (F.to_json("_normal") != F.to_json("gold_spans")) & (F.size("gold_spans") > 0)
    issues = F.concat(F.when(odd, F.array(F.lit("gold_spans_not_normalized"))).otherwise(F.array().cast("array<string>")), got["issues"])
    rows = rows.withColumns({"issues": issues, **{k: v for k, v in got.items() if k != "issues"}})
    return rows.select("sample_id", "tool_type", F.when(F.size("issues") == 0, "pass").otherwise("fail").alias("status"), "issues", "n_output_lines", "n_relevant_lines", "duplicate_count")


def audit_chat(df: DataFrame) -> DataFrame:
    """The columns of chat rows (prompt, response, num_relevant_lines) with status, issues, present, in_place, duplicates and corrected_num.

    The response is a JSON object with a list of strings. Lines must stand in the prompt's user part, in order.
    """
    body = D.user_body(F.col("prompt"))
    parsed = F.try_parse_json(F.col("response"))
    listed = F.try_variant_get(parsed, "$.relevant_lines", "array<variant>")
    kinds = F.transform(listed, lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    lines = F.coalesce(F.when(~F.exists(kinds, lambda k: ~k), F.transform(listed, lambda v: F.try_variant_get(v, "$", "string"))), F.array().cast("array<string>"))
    bad = F.when(parsed.isNull(), "invalid_response_json").when(listed.isNull(), "relevant_lines_not_list").when(F.exists(kinds, lambda k: ~k), "relevant_lines_not_all_strings")
    rows = df.withColumns({"_body": body, "_lines": lines, "_bad": bad})
    found = F.forall("_lines", lambda x: F.col("_body").contains(x))

    def step(at: Column, x: Column) -> Column:
        pos = F.call_function("locate", x, F.col("_body"), at)
        return F.when((at == 0) | (pos == 0), 0).otherwise(pos + F.length(x))

    placed = F.aggregate("_lines", F.lit(1), step) != 0
    rows = rows.withColumns({"present": F.col("_bad").isNull() & found, "in_place": F.col("_bad").isNull() & found & placed})
    code = F.coalesce("_bad", F.when(~F.col("present"), "relevant_line_missing_from_prompt").when(~F.col("in_place"), "relevant_lines_out_of_order"))
    rows = rows.withColumns({"issues": F.array_compact(F.array(code)), "duplicates": duplicates(F.col("_lines"))})
    rows = rows.withColumns({"status": F.when(F.size("issues") == 0, "pass").otherwise("fail"), "corrected_num": F.when(F.size("issues") == 0, F.size("_lines").cast("long")).otherwise(F.col("num_relevant_lines").cast("long"))})
    return rows.drop("_body", "_lines", "_bad")


def chat_report(audited: DataFrame) -> DataFrame:
    """One row over audited chat rows: samples, passing, failing, corrected counts, rows with repeated lines, all totals zero."""
    return audited.agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("status") == "pass").alias("passing"), F.count_if(F.col("status") == "fail").alias("failing"),
        F.count_if(~F.col("num_relevant_lines").eqNullSafe(F.col("corrected_num"))).alias("corrected"), F.count_if(F.col("duplicates") > 0).alias("with_duplicates"),
        F.coalesce(F.bool_and(F.coalesce(F.col("num_total_lines") == 0, F.lit(False))), F.lit(True)).alias("all_totals_zero"),
    )
