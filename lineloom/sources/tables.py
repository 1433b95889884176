"""Sources and sinks: JSON lines and documents, whole texts, stage tables, resumable appends, reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True, blanks: bool = True) -> DataFrame:
    """One object a line; a malformed line raises if ``strict``, else its fields are null. Blank lines are skipped; without
    ``blanks`` they raise."""
    if not blanks and spark.read.text(path).where(F.trim("value") == "").take(1):
        raise ValueError(f"blank line in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A whole-file array or object."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once: read if it is there (whole), else made and written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unfinished(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the finished ones; a null key is a key."""
    cond = F.lit(True)
    a, b = df.alias("a"), done.select(*keys).distinct().alias("b")
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, cond, "left_anti")


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row result as a JSON document on the driver's machine."""
    rows = [r.asDict(recursive=True) for r in df.limit(1).collect()]
    report = rows[0] if rows else {}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(report, f, indent=2, default=str)
    return report


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table as Markdown text."""
    head = df.columns
    rows = [[str(v) for v in r] for r in df.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def config(path_or_paths: str | list[str]) -> dict:
    """The first settings file that exists; {} if none does. JSON always works, YAML where its package is installed."""
    for p in [path_or_paths] if isinstance(path_or_paths, str) else path_or_paths:
        if os.path.exists(p):
            with open(p) as f:
                if p.endswith(".json"):
                    return json.load(f)
                import yaml

                return yaml.safe_load(f) or {}
    return {}


def first_setting(*values: str | None) -> str | None:
    """The first value that isn't empty: argument, environment, file."""
    return next((v for v in values if v), None)
