"""Tool calls: which tools to run for an instance, and what to ask of their output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import patches as P

#: Weights of tools; they add up to 1.
WEIGHTS = {
    "read_file": 0.28, "grep": 0.18, "python": 0.08, "git_log": 0.08, "test_output": 0.08, "git_diff": 0.05, "git_blame": 0.04,
    "ls": 0.04, "lint_output": 0.02, "build_output": 0.02, "curl": 0.03, "pip_install": 0.04, "type_check": 0.04, "coverage": 0.02,
}
LEAST, MOST = 3, 7

#: What is asked of a tool's output about a focus.
ASK = {
    "read_file": "Find the code block most relevant to how {} is handled.",
    "grep": "Find the grep hits most relevant to how {} is handled.",
    "git_log": "Find the commit entry most relevant to {}.",
    "git_diff": "Find the diff hunk most relevant to how {} changes.",
    "git_blame": "Find the blame block most relevant to {}.",
    "ls": "Find the directory entries most relevant to {}.",
    "test_output": "Find the failure block most relevant to {}.",
    "build_output": "Find the failure block most relevant to {}.",
    "lint_output": "Find the failure block most relevant to {}.",
    "type_check": "Find the failure block most relevant to {}.",
    "coverage": "Find the failure block most relevant to {}.",
    "python": "Find the runtime output block most relevant to {}.",
    "curl": "Find the API or docs block most relevant to how {} is described.",
    "pip_install": "Find the dependency error block most relevant to {}.",
}
#: Fixed value: the same for any other tool.
ASK_OTHER = "Find the evidence block most relevant to {}."
NO_FOCUS = "the relevant bug behavior"


#: What is asked of a tool's output where nothing better is known.
FALLBACK = {
    "read_file": "Find the smallest code block most relevant to the task.",
    "git_diff": "Find the smallest diff hunk most relevant to the task.",
    "grep": "Find the grep hits most relevant to the task.",
    "ls": "Find the file or directory entries most relevant to the task.",
    "git_log": "Find the commit entry most relevant to the task.",
    "git_blame": "Find the blame block most relevant to the task.",
    "test_output": "Find the failure block most relevant to the task.",
    "build_output": "Find the failure block most relevant to the task.",
    "type_check": "Find the failure block most relevant to the task.",
    "lint_output": "Find the failure block most relevant to the task.",
    "pip_install": "Find the failure block most relevant to the task.",
    "python": "Find the runtime output block most relevant to the task.",
    "curl": "Find the returned docs or API block most relevant to the task.",
}
FALLBACK_OTHER = "Find the evidence block most relevant to the task."
#: Share of reads of the patch's own files; siblings of a file, files whose siblings count, siblings in all.
OWN_SHARE, SIBLINGS_EACH, SIBLINGS_OF, SIBLINGS_ALL = 0.8, 6, 5, 15


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash of the key, the same in every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 6), 16, 10).cast("long") / F.lit(16777216.0)


def focus(patch: Column, issue: Column) -> Column:
    """What a query is about: a function, class, message or variable of the patch, a term of the issue, else its file."""
    kinds = P.identifiers(patch)
    first = [F.get(kinds[k], F.lit(0)) for k in ("functions", "classes", "error_strings", "variables")]
    file = F.replace(X.stem(F.get(P.files(patch), F.lit(0))), F.lit("_"), F.lit(" "))
    return F.coalesce(*first, F.get(P.issue_terms(issue), F.lit(0)), file, F.lit(NO_FOCUS))


def extraction_query(tool: Column, about: Column) -> Column:
    fill = lambda t: F.concat(F.lit(t.split("{}")[0]), about, F.lit(t.split("{}")[1]))
    out = None
    for kind, t in ASK.items():
        out = F.when(tool == kind, fill(t)) if out is None else out.when(tool == kind, fill(t))
    return out.otherwise(fill(ASK_OTHER))


def plan(instances: DataFrame) -> DataFrame:
    """instance_id, seq (from 0), tool_type: between ``LEAST`` and ``MOST`` tools, the first reads a file, the others
    are drawn with replacement by weight."""
    n = F.lit(LEAST) + F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("n"), "instance_id")), 1, 6), 16, 10).cast("long") % (MOST - LEAST + 1)
    rows = instances.select("instance_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq"))
    u = uniform(F.lit("tool"), F.col("instance_id"), F.col("seq"))
    case, upto = F.when(F.col("seq") == 0, "read_file"), 0.0
    for kind, w in list(WEIGHTS.items())[:-1]:
        upto = round(upto + w, 10)
        case = case.when(F.col("u") < upto, kind)
    return rows.withColumn("u", u).select("instance_id", F.col("seq").cast("int").alias("seq"), case.otherwise(list(WEIGHTS)[-1]).alias("tool_type"))


def fallback_query(tool: Column, hint: Column) -> Column:
    """The hint, else the question of the tool type."""
    known = F.create_map(*(F.lit(x) for pair in FALLBACK.items() for x in pair))
    return F.coalesce(F.nullif(hint, F.lit("")), F.try_element_at(known, tool), F.lit(FALLBACK_OTHER))


def _own_files(instances: DataFrame) -> DataFrame:
    """instance_id, own (place from 0), file, dir of the files of a patch."""
    rows = instances.select("instance_id", F.posexplode(P.files(F.col("patch"))).alias("own", "file"))
    return rows.withColumn("dir", X.parent(F.col("file")))


def siblings(own: DataFrame, files: DataFrame) -> DataFrame:
    """instance_id, file, dir of available files (instance_id, file) that the patch doesn't touch."""
    rest = files.join(own.select("instance_id", "file"), ["instance_id", "file"], "left_anti")
    return rest.withColumn("dir", X.parent(F.col("file")))


def _pick(rows: DataFrame, salt: str, name: str) -> DataFrame:
    """One file of each instance, by hash."""
    return rows.groupBy("instance_id").agg(F.min_by("file", F.md5(F.concat_ws("|", F.lit(salt), "instance_id", "file"))).alias(name))


def read_targets(instances: DataFrame, files: DataFrame) -> DataFrame:
    """instance_id, target, is_patch_file: ``OWN_SHARE`` of the instances read a file of their patch, the others a
    sibling, of a folder of the patch if there is any; without the one kind they read the other."""
    own = _own_files(instances)
    rest = siblings(own, files).join(own.select("instance_id", "dir").distinct().withColumn("near", F.lit(True)), ["instance_id", "dir"], "left")
    related = rest.where("near").select("instance_id").distinct()
    pool = rest.where("near").select("instance_id", "file").unionByName(rest.join(related, "instance_id", "left_anti").select("instance_id", "file"))
    rows = instances.select("instance_id").join(_pick(own, "patch", "mine"), "instance_id", "left").join(_pick(pool, "decoy", "decoy"), "instance_id", "left")
    is_own = F.col("mine").isNotNull() & (F.col("decoy").isNull() | (uniform(F.lit("read"), F.col("instance_id")) < OWN_SHARE))
    return rows.where("mine is not null or decoy is not null").select("instance_id", F.when(is_own, F.col("mine")).otherwise(F.col("decoy")).alias("target"), is_own.alias("is_patch_file"))


def source_plan(instances: DataFrame, files: DataFrame) -> DataFrame:
    """instance_id, file, kind ('patch' or 'sibling'): what to fetch, siblings by name within the limits."""
    own = _own_files(instances)
    near = own.where(F.col("own") < SIBLINGS_OF).select("instance_id", "own", "dir").join(siblings(own, files), ["instance_id", "dir"])
    near = near.withColumn("r", F.row_number().over(W.partitionBy("instance_id", "own").orderBy("file"))).where(F.col("r") <= SIBLINGS_EACH).select("instance_id", "file").distinct()
    near = near.withColumn("n", F.row_number().over(W.partitionBy("instance_id").orderBy("file"))).where(F.col("n") <= SIBLINGS_ALL)
    return own.select("instance_id", "file", F.lit("patch").alias("kind")).unionByName(near.select("instance_id", "file", F.lit("sibling").alias("kind")))
