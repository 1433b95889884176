"""Dataset views and assembly: canonical rows, prompts and responses, splits, negatives, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..runtime import head_by_hash, ranked, stable
from . import spans as S

#: Fixed value: the instruction of prompts.
SYSTEM = "You prune verbose tool output for a coding agent. Given a focused extraction query and one tool output, return only the smallest verbatim evidence block(s) the agent should read next. Return the kept text inside <relevant_lines> tags. Do not rewrite, summarize, or invent lines."
#: Repositories whose rows are held out.
HELD_OUT = {"test": ("pydata__xarray", "pallets__flask"), "dev": ("psf__requests",)}
EOS = "<|im_end|>"


def canonical(df: DataFrame) -> DataFrame:
    """Rows with normalised spans; is_irrelevant is filled from them where null."""
    return df.withColumn("gold_spans", S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output")))).withColumn("is_irrelevant", F.coalesce("is_irrelevant", F.size("gold_spans") == 0))


def prompt(query: Column, output: Column, background: Column, query_chars: int | None = 1000, background_chars: int | None = 3000) -> Column:
    """Chat prompt; query and background are cut at their limits, the background's block is left out if it's empty."""
    b = F.coalesce(background, F.lit(""))
    if query_chars:
        query, b = X.ellipsis(query, query_chars), X.ellipsis(b, background_chars)
    block = F.when(b != "", F.concat(F.lit("<background_task>\n"), b, F.lit("\n</background_task>\n"))).otherwise("")
    return F.concat(
        F.lit(f"<|im_start|>system\n{SYSTEM}<|im_end|>\n<|im_start|>user\n<query>\n"), query, F.lit("\n</query>\n"), block,
        F.lit("<tool_output>\n"), output, F.lit("\n</tool_output><|im_end|>\n<|im_start|>assistant\n"),
    )


def messages(task: Column, output: Column) -> Column:
    """Two chat messages; the task is cut at 3000 characters and left out if empty."""
    t = X.ellipsis(F.coalesce(task, F.lit("")), 3000)
    user = F.concat(F.when(t != "", F.concat(F.lit("<query>\n"), t, F.lit("\n</query>\n"))).otherwise(""), F.lit("<tool_output>\n"), output, F.lit("\n</tool_output>"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def parse_prompt(text: Column) -> dict[str, Column]:
    """Query (else task), background and output of a prompt; '' where absent."""
    get = lambda n: F.regexp_extract(text, rf"(?s)<{n}>\n(.*?)\n</{n}>", 1)
    has = text.rlike(r"(?s)<query>\n.*?\n</query>")
    return {"query": F.when(has, get("query")).otherwise(get("task")), "background": get("background_task"), "output": get("tool_output")}


def parse_lines(reply: Column) -> Column:
    """Relevant lines of a reply, stripped, without blank ones.

    They are the list of a JSON object ([] if it has none), else the content of the tag, else the reply itself; a JSON
    reply that is no object, or whose value is no list, is taken as plain text. Values that are no strings are written out.
    """
    s = X.strip(reply)
    parsed = F.try_parse_json(s)
    value = F.try_variant_get(parsed, "$.relevant_lines", "string")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    listed = F.try_variant_get(parsed, "$.relevant_lines", "array<variant>")
    no_list = F.coalesce(listed.isNull() & (value.isNotNull() | F.coalesce(F.schema_of_variant(parsed).contains("relevant_lines"), F.lit(False))), F.lit(False))
    items = F.transform(F.coalesce(listed, F.array().cast("array<variant>")), lambda v: X.strip(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("None"))))
    body = F.when(s.rlike(r"(?s)<relevant_lines>.*</relevant_lines>"), X.strip(X.tag(s, "relevant_lines"))).otherwise(s)
    filled = lambda xs: F.filter(xs, lambda x: x != "")
    return F.when(is_object & ~no_list, filled(items)).otherwise(filled(F.transform(X.lines(body), X.strip)))


def convert(df: DataFrame) -> DataFrame:
    """prompt, response and tool_type of chat rows -> task, tool_output, relevant_lines, tool_type of encoder rows.

    Sections are stripped; rows without a task or an output go. Of the response's lines blank ones and omission notes go.
    """
    def section(name: str) -> Column:
        return X.strip(X.tag(F.col("prompt"), name))

    has = F.col("prompt").rlike(r"(?s)<query>.*?</query>")
    body = X.strip(X.tag(F.col("response"), "relevant_lines"))
    note = r"^\.\.\.\s*\(\d+\s+lines?\s+omitted\)\s*$"
    lines = F.filter(X.lines(body), lambda x: (X.strip(x) != "") & ~X.strip(x).rlike(note))
    rows = df.withColumns({"task": F.when(has, section("query")).otherwise(section("task")), "tool_output": section("tool_output"), "relevant_lines": lines})
    keep = [c for c in df.columns if c not in ("prompt", "response", "tool_type", "task", "tool_output", "relevant_lines")]
    return rows.where("task <> '' and tool_output <> ''").select(*keep, "task", "tool_output", "relevant_lines", F.coalesce("tool_type", F.lit("unknown")).alias("tool_type"))


def training_text(prompt_: Column, response: Column, eos: str = EOS) -> Column:
    return F.concat(prompt_, response, F.lit(eos))


def user_body(prompt_: Column) -> Column:
    """What stands between the first start of a user turn and the last start of an answer; '' without both."""
    start, end = "<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n"
    tail = F.substring(prompt_, F.length(F.substring_index(prompt_, start, 1)) + len(start) + 1, F.length(prompt_))
    inner = F.when(tail.contains(end), F.regexp_extract(tail, r"(?s)^(.*)<\|im_end\|>\n<\|im_start\|>assistant\n", 1)).otherwise(tail)
    return F.when(prompt_.contains(start) & prompt_.contains(end), inner).otherwise("")


def repo_split(instance_id: Column) -> Column:
    """Split of real rows, by sets of repositories."""
    repo = X.repo_of(instance_id)
    return F.when(repo.isin(*HELD_OUT["test"]), "test").when(repo.isin(*HELD_OUT["dev"]), "dev").otherwise("train")


def sft(df: DataFrame) -> DataFrame:
    """prompt, response and metadata of canonical rows that have a query and an output."""
    rows = df.where("query <> '' and tool_output <> ''")
    total, lines = S.n_lines(F.col("tool_output")), S.extract(F.col("tool_output"), F.col("gold_spans"))
    n = F.size(lines)
    inner = F.when(n > 0, F.concat(F.lit("<relevant_lines>\n"), F.array_join(lines, "\n"), F.lit("\n</relevant_lines>"))).otherwise(F.lit("<relevant_lines>\n</relevant_lines>"))
    return rows.select(
        "sample_id", "instance_id", "tool_type", "source", prompt(F.col("query"), F.col("tool_output"), F.col("background_task")).alias("prompt"), inner.alias("response"),
        total.cast("long").alias("num_total_lines"), n.cast("long").alias("num_relevant_lines"), F.round(1 - n / total, 4).alias("compression_ratio"),
    )


def encoder(df: DataFrame) -> DataFrame:
    rows = df.where("query <> '' and tool_output <> ''")
    return rows.select("sample_id", F.col("query").alias("task"), "tool_output", S.extract(F.col("tool_output"), F.col("gold_spans")).alias("relevant_lines"), "tool_type")


def order_key(seed: int, *key: Column) -> Column:
    """A hash that orders rows as if drawn at random, the same in every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key)))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that comes last; one aggregate with partial results, no sort of whole rows."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def group_splits(groups: DataFrame, test: float = 0.10, dev: float = 0.05, seed: int = 42) -> DataFrame:
    """tool_type, group_id -> split_name: by hashed rank in the tool type the first tenth (one at least) is test, the
    next twentieth (one at least) dev, the rest train."""
    by = W.partitionBy("tool_type")
    ranked = groups.select("tool_type", "group_id").distinct().withColumn("rank", F.row_number().over(by.orderBy(order_key(seed, F.col("group_id")), "group_id"))).withColumn("n", F.count("*").over(by))
    n_test = F.greatest(F.lit(1), (F.col("n").cast("double") * F.lit(test)).cast("int"))
    n_dev = F.greatest(F.lit(1), (F.col("n").cast("double") * F.lit(dev)).cast("int"))
    return ranked.select("tool_type", "group_id", F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_dev, "dev").otherwise("train").alias("split_name"))


def made_splits(rows: DataFrame) -> DataFrame:
    """sample_id, split_name of made rows (sample_id, source, tool_type, group_id).

    A positive has the split of its group within its tool type. A negative follows its group: the split of the tool type
    that came last (by its first row) of those the group is in, and train where no positive is of the group.
    """
    made = rows.where("source = 'synthetic'")
    splits = stable(group_splits(made.select("tool_type", "group_id")))
    came = made.groupBy("tool_type").agg(F.min("sample_id").alias("came"))  # a row a tool type
    last = splits.join(F.broadcast(came), "tool_type").groupBy("group_id").agg(F.max_by("split_name", "came").alias("split_name"))
    first = made.join(splits, ["tool_type", "group_id"]).select("sample_id", "split_name")
    rest = rows.where("source = 'synthetic_negative'").join(last, "group_id", "left")
    return first.unionByName(rest.select("sample_id", F.coalesce("split_name", F.lit("train")).alias("split_name")))


def negatives(rows: DataFrame, ratio: float = 0.15, seed: int = 42) -> DataFrame:
    """Hard negatives: the query of one row with the output of another of a different tool type.

    rows: sample_id, tool_type, query. The outputs are the ``ratio`` of rows that come first in hashed order; the k-th
    takes the query of the k-th row in another hashed order, or of the next ones up to ten, the first of another tool
    type. Pairs that find none are left out, as a bounded number of draws would.
    """
    total = rows.count()
    n = max(1, int(total * ratio)) if total > 1 else 0
    first = lambda seed_, most: ranked(head_by_hash(rows.withColumn("_h", order_key(seed_, F.col("sample_id"))), "_h", most), F.col("_h"), F.col("sample_id"), name="k").where(F.col("k") < most)
    outputs = first(seed, n).select("k", F.col("sample_id").alias("output_id"), F.col("tool_type").alias("output_tool"))
    asks = first(seed + 1, n + 10).select("k", F.col("sample_id").alias("query_id"), F.col("tool_type").alias("query_tool"), "query")
    tried = outputs.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("q", F.col("k") + F.col("try"))
    met = tried.join(asks.withColumnRenamed("k", "q"), "q").where("query_tool <> output_tool and query_id <> output_id")
    return met.groupBy("output_id", "output_tool").agg(F.min_by(F.struct("query_id", "query_tool", "query"), "try").alias("r")).select("output_id", "output_tool", "r.*")
