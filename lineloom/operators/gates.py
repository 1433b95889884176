"""Gates that rows must pass before they are kept, and the filters and orders of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import lines as L
from . import spans as S

#: Least characters of a query, least filled lines of an output, most relevant share of them.
LEAST_QUERY, LEAST_FILLED, MOST_RELEVANT = 10, 5, 0.6


def filled_lines(text: Column) -> Column:
    return F.size(F.filter(X.lines(text), lambda x: ~X.is_blank(x)))


def valid_numbers(text: Column, numbers: Column) -> Column:
    """Sorted distinct line numbers that name a filled line of the text."""
    lines = X.lines(text)
    good = F.filter(F.array_distinct(numbers), lambda n: (n >= 1) & (n <= F.size(lines)) & ~X.is_blank(F.get(lines, n - 1)))
    return F.array_sort(good)


def generated(df: DataFrame, numbers: Column) -> DataFrame:
    """Generated rows (query, tool_output) with their valid line numbers (``numbers``), if query and output are long enough
    and between one line and ``MOST_RELEVANT`` of the filled ones is relevant."""
    rows = df.withColumns({"numbers": valid_numbers(F.col("tool_output"), numbers), "n_filled": filled_lines(F.col("tool_output"))})
    n = F.size("numbers")
    return rows.where((F.length("query") >= LEAST_QUERY) & (F.col("n_filled") >= LEAST_FILLED) & (n > 0) & (n / F.col("n_filled") <= MOST_RELEVANT))


def distilled(df: DataFrame) -> DataFrame:
    """Rows whose spans leave some text that, omission notes included, has no more lines than the output; adds distilled_lines, compression_ratio and kept_lines."""
    n = S.n_lines(F.col("tool_output"))
    spans = S.normalise(F.col("gold_spans"), n)
    rows = df.withColumns({"_text": L.kept_text(F.col("tool_output"), spans), "kept_lines": S.covered_lines(F.col("gold_spans"))})
    rows = rows.withColumn("distilled_lines", S.n_lines(F.col("_text"))).withColumn("_ratio", 1 - F.col("distilled_lines") / n)
    return rows.where(~X.is_blank(F.col("_text")) & (F.col("_ratio") >= 0)).withColumn("compression_ratio", F.round("_ratio", 4)).drop("_text", "_ratio")


def with_evidence(df: DataFrame) -> DataFrame:
    """Rows that have spans, and explicit negatives."""
    return df.where((F.size(F.coalesce("gold_spans", F.array().cast(S.SPANS))) > 0) | F.coalesce(F.col("source") == "synthetic_negative", F.lit(False)))


def unknown_tools(configs: DataFrame, wanted: list[str]) -> DataFrame:
    """tool_type of what is asked for and isn't configured."""
    asked = configs.sparkSession.createDataFrame([(t,) for t in wanted], "tool_type string").distinct()
    return asked.join(configs.select("tool_type"), "tool_type", "left_anti")


def pick_tools(configs: DataFrame, wanted: list[str]) -> DataFrame:
    """The configurations of some tools; an unknown one raises. No tool asked for means all."""
    missing = sorted(r.tool_type for r in unknown_tools(configs, wanted).collect()) if wanted else []  # of the list that was given
    if missing:
        raise ValueError(f"unknown tool types: {missing}")
    return configs.where(F.col("tool_type").isin(wanted)) if wanted else configs


#: Review filters over f1, exact_match, fuzzy_f1, category, ref and error; a missing measure counts as 0.
def review_modes() -> dict[str, Column]:
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kind = lambda k: F.coalesce(F.col("category") == k, F.lit(False))
    n_ref = F.coalesce(F.size("ref"), F.lit(0))
    return {
        "all": F.lit(True), "errors": F.coalesce(F.col("error") != "", F.lit(False)), "bad_exact": value("exact_match") == 0, "bad_fuzzy": value("fuzzy_f1") < 0.5,
        "false_negative": kind("false_negative"), "false_positive": kind("false_positive"), "empty_gold": n_ref <= 0, "nonempty_gold": n_ref > 0,
    }


#: Review orders: column, and whether the largest comes first; ties stay in the original order.
REVIEW_ORDERS = {
    "original": (None, False), "lowest_f1": ("f1", False), "highest_f1": ("f1", True), "lowest_fuzzy": ("fuzzy_f1", False), "highest_fuzzy": ("fuzzy_f1", True),
    "highest_rouge": ("rouge_l", True), "highest_compression": ("compression", True),
}


def review_order(mode: str, index: str) -> list[Column]:
    """Sort columns of a review order; a missing measure counts as 0."""
    column, largest = REVIEW_ORDERS[mode]
    if column is None:
        return [F.col(index)]
    v = F.coalesce(F.col(column), F.lit(0.0))
    return [-v if largest else v, F.col(index)]


def review_search(text: str) -> Column:
    """Case-insensitive search in task, output, prompt, predicted and reference lines, and error."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("task", "tool_output", "prompt")] + [F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "\n") for c in ("pred", "ref")] + [F.coalesce("error", F.lit(""))]
    return F.lower(F.concat_ws("\n", *parts)).contains(text.lower())


#: Tools a dataset is expected to have, mean compression under which it is warned of, least evaluation rows, longest prompt.
EXPECTED = ("read_file", "grep", "git_log", "test_output", "git_diff")
LEAST_RATIO, LEAST_EVAL, LONGEST_PROMPT = 0.5, 10, 50_000


def warnings(chat: DataFrame) -> DataFrame:
    """warning, value of a dataset of chat rows (prompt, response, compression_ratio, tool_type, is_eval); no row if all is well."""
    got = chat.agg(
        F.count("*").cast("double").alias("n"), F.avg("compression_ratio").alias("ratio"), F.count_if(F.col("is_eval")).cast("double").alias("n_eval"), F.count_if(F.length("prompt") > LONGEST_PROMPT).cast("double").alias("long"),
        F.count_if(X.is_blank(F.col("response"))).cast("double").alias("empty"), F.size(F.array_except(F.array(*map(F.lit, EXPECTED)), F.collect_set("tool_type"))).cast("double").alias("missing"),
    )
    warn = lambda name, when, value: F.when(when, F.struct(F.lit(name).alias("warning"), value.alias("value")))
    some = F.col("n") > 0
    all_ = F.array(
        warn("no_samples", ~some, F.col("n")), warn("mean_ratio_low", some & (F.col("ratio") < LEAST_RATIO), F.round("ratio", 4)), warn("missing_tools", some & (F.col("missing") > 0), F.col("missing")),
        warn("few_eval_samples", some & (F.col("n_eval") < LEAST_EVAL), F.col("n_eval")), warn("long_prompts", F.col("long") > 0, F.col("long")), warn("empty_responses", F.col("empty") > 0, F.col("empty")),
    )
    return got.select(F.inline(F.array_compact(all_)))
