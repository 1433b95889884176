"""Unified diffs: files, changed ranges, names; and labels of tool output lines that a patch makes relevant."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: A labelled output has at least so many lines and relevant lines, and a share of relevant ones between these.
LEAST_LINES, LEAST_RELEVANT, LEAST_SHARE, MOST_SHARE = 10, 3, 0.02, 0.40
#: Fixed value: lines around a changed range in which a search hit counts as near it.
NEAR = 10
_NUMBERED = re.compile(r"^\d+: (.*)$")
HUNKS = "array<struct<file:string,start:int,stop:int>>"


def files(patch: Column) -> Column:
    """Changed files in order of appearance: after ' b/' of a header that has it once, or after '+++ b/'."""
    def of(line: Column) -> Column:
        parts = F.split(line, " b/", -1)
        head = F.when(line.startswith("diff --git") & (F.size(parts) == 2), X.strip(F.get(parts, F.lit(1))))
        plus = F.when(~line.startswith("diff --git") & line.startswith("+++ b/"), X.strip(F.substring(line, 7, 1 << 30)))
        return F.coalesce(head, F.when(plus != "/dev/null", plus))

    return F.array_distinct(F.array_compact(F.transform(X.lines(patch), of)))


def hunks(patch: Column) -> Column:
    """(file, start, stop) of the new side of each '@@' header after a '+++ b/' line; count 1 if absent, 0 is an empty
    range; headers that don't parse are left out."""
    start = F.struct(F.lit(None).cast("string").alias("file"), F.array().cast(HUNKS).alias("out"))

    def step(a: Column, line: Column) -> Column:
        file = F.when(line.startswith("+++ b/"), X.strip(F.substring(line, 7, 1 << 30))).otherwise(a["file"])
        part = F.regexp_extract(line, r"^@@ [^+]*\+(\d+(?:,\d+)?) [^@]*@@", 1)
        n = F.split(part, ",")
        first = F.get(n, F.lit(0)).try_cast("int")
        count = F.coalesce(F.get(n, F.lit(1)).try_cast("int"), F.lit(1))
        hit = (part != "") & file.isNotNull() & first.isNotNull()
        one = F.array(F.struct(file.alias("file"), first.alias("start"), (first + count - 1).alias("stop"))).cast(HUNKS)
        return F.struct(file.alias("file"), F.concat(a["out"], F.when(hit, one).otherwise(F.array().cast(HUNKS))).alias("out"))

    return F.aggregate(X.lines(patch), start, step, lambda a: a["out"])


def names(patch: Column) -> Column:
    """Functions and classes that a patch names, sorted."""
    found = F.concat(F.regexp_extract_all(patch, F.lit(r"def (\w+)"), 1), F.regexp_extract_all(patch, F.lit(r"class (\w+)"), 1))
    return F.array_sort(F.array_distinct(found))


def identifiers(patch: Column) -> dict[str, Column]:
    """Sorted distinct names by kind; sorting before the caps of 5 and 10 makes them repeatable."""
    pick = lambda rx: F.array_sort(F.array_distinct(F.regexp_extract_all(patch, F.lit(rx), 1)))
    return {
        "functions": pick(r"def (\w+)"),
        "classes": pick(r"class (\w+)"),
        "error_strings": F.slice(pick(r"[\"']([A-Za-z_]\w{5,}(?:\s\w+){0,3})[\"']"), 1, 5),
        "variables": F.slice(pick(r"(\w{3,})\s*="), 1, 10),
    }


def issue_terms(text: Column) -> Column:
    """Quoted code and camel-case names of an issue, sorted, ten at most."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"`([^`]{3,50})`"), 1), F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), 1))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 10)


def patch_table(instances: DataFrame) -> DataFrame:
    """instance key, patch_files, hunks, names: what the labels need of a patch."""
    p = F.col("patch")
    return instances.select("instance_id", files(p).alias("patch_files"), hunks(p).alias("hunks"), names(p).alias("names"))


def _any(markers: Column, line: Column) -> Column:
    return F.exists(markers, lambda m: F.contains(line, m))


def label_grep() -> Column:
    def one(line: Column) -> Column:
        file = F.regexp_extract(line, r"^([^:]+):(\d+):", 1)
        n = F.regexp_extract(line, r"^([^:]+):(\d+):", 2).try_cast("int")
        own = F.filter("hunks", lambda h: h["file"] == file)
        near = F.exists(own, lambda h: n.between(h["start"] - NEAR, h["stop"] + NEAR))
        return (file != "") & F.array_contains("patch_files", file) & F.coalesce(near | (F.size(own) == 0), F.lit(False))

    return F.transform("lines", one)


def label_git_log() -> Column:
    low = F.transform("names", F.lower)
    return F.transform("lines", lambda x: _any(low, F.lower(x)))


def label_test_output() -> Column:
    """A line 'FAIL:' or 'ERROR:' opens a block that a line of dashes closes; outside, 'FAILED' and 'Error' count."""
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        opens = x.startswith("FAIL:") | x.startswith("ERROR:")
        closes = ~opens & x.startswith("---") & a["open"]
        hit = opens | a["open"] | F.contains(x, F.lit("FAILED")) | F.contains(x, F.lit("Error"))
        return F.struct(((opens | a["open"]) & ~closes).alias("open"), F.array_append(a["out"], hit).alias("out"))

    return F.aggregate("lines", start, step, lambda a: a["out"])


def label_git_diff() -> Column:
    def one(x: Column) -> Column:
        changed = (x.startswith("+") | x.startswith("-")) & ~x.startswith("+++") & ~x.startswith("---")
        return changed | x.startswith("@@") | x.startswith("diff --git")

    return F.transform("lines", one)


def label_ls() -> Column:
    base = F.transform("patch_files", X.basename)
    return F.transform("lines", lambda x: _any(base, x))


def label_generic() -> Column:
    markers = F.array_union("patch_files", "names")
    return F.transform("lines", lambda x: _any(markers, x))


def enclosing(content: list[str], targets: list[int]) -> set[int]:
    """Lines of the definitions around target lines: a def or class line up to the next one that is indented no more
    encloses what is indented more. One pass, with the open definitions on a stack."""
    wanted = set(targets)
    out: set[int] = set()
    open_: list[tuple[int, int]] = []
    for i, x in enumerate(content, 1):
        bare = x.lstrip()
        depth = len(x) - len(bare)
        if i in wanted:
            for level, at in reversed(open_):
                if level < depth and at in out:
                    break
                if level < depth:
                    out.add(at)
        if bare.startswith(("def ", "class ")):
            while open_ and open_[-1][0] >= depth:
                open_.pop()
            open_.append((depth, i))
    return out


def read_file_labels(lines: list[str], hunks_: list, touched: bool, names_: list[str]) -> list[bool]:
    """Changed lines of a file that was read, definitions around them, and imports of names of the patch; of a file that
    the patch doesn't touch no line is relevant. Line numbers before the lines are ignored."""
    content = [m.group(1) if (m := _NUMBERED.match(x)) else x for x in lines]
    relevant: set[int] = set()
    if len(hunks_) or touched:
        for h in hunks_:
            relevant.update(range(max(h["start"], 1), min(h["stop"], len(content)) + 1))
        relevant |= enclosing(content, sorted(relevant))
        for i, x in enumerate(content, 1):
            s = x.strip()
            if s.startswith(("import ", "from ")) and any(n in s for n in names_):
                relevant.add(i)
    return [i in relevant for i in range(1, len(content) + 1)]


def _label_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        labels = [read_file_labels(list(a), list(h), bool(t), list(n)) for a, h, t, n in zip(pdf.lines, pdf.own, pdf.touched, pdf.names)]
        yield pd.DataFrame({"id": pdf.id, "tool_type": pdf.tool_type, "labels": labels})


LABELERS = {
    "grep": label_grep, "git_log": label_git_log, "test_output": label_test_output, "git_diff": label_git_diff, "ls": label_ls,
    "git_blame": label_generic, "lint_output": label_generic, "build_output": label_generic,
}


def label(outputs: DataFrame, patches: DataFrame, read_files: bool = True) -> DataFrame:
    """outputs: id, instance_id, tool_type, command, text -> id, tool_type, labels (array<boolean>, one a line).

    Only tool types that have a rule, and outputs whose instance has a patch, are labelled.
    """
    kinds = [*LABELERS, *(["read_file"] if read_files else [])]
    rows = outputs.where(F.col("tool_type").isin(kinds)).join(patches, "instance_id").withColumn("lines", X.lines(F.col("text")))
    case = None
    for kind, rule in LABELERS.items():
        case = F.when(F.col("tool_type") == kind, rule()) if case is None else case.when(F.col("tool_type") == kind, rule())
    out = rows.where(F.col("tool_type") != "read_file").select("id", "tool_type", case.alias("labels"))
    if read_files:
        target = F.regexp_extract("command", r"(\S+)\s*$", 1)
        mine = rows.where(F.col("tool_type") == "read_file").withColumn("target", target)
        own = F.filter("hunks", lambda h: h["file"] == F.col("target"))
        out = out.unionByName(
            mine.select("id", "tool_type", "lines", own.alias("own"), F.coalesce(F.array_contains("patch_files", F.col("target")), F.lit(False)).alias("touched"), "names")
            .mapInPandas(_label_files, f"id {dict(rows.dtypes)['id']}, tool_type string, labels array<boolean>")
        )
    return out


def quality_gate(labelled: DataFrame) -> DataFrame:
    """id, tool_type, n_lines, n_relevant, ratio of the labelled outputs that are neither too easy nor too hard."""
    n, r = F.size("labels"), F.size(F.filter("labels", lambda x: x))
    got = labelled.select("id", "tool_type", n.cast("long").alias("n_lines"), r.cast("long").alias("n_relevant"), (r / n).alias("ratio"))
    return got.where((F.col("n_lines") >= LEAST_LINES) & (F.col("n_relevant") >= LEAST_RELEVANT) & F.col("ratio").between(LEAST_SHARE, MOST_SHARE)).withColumn("ratio", F.round("ratio", 4))
