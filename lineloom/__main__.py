"""Command line: ``extract`` prunes a text for a query, ``run`` writes a registered query's result.

    python -m lineloom extract "why does the test fail" < log.txt
    python -m lineloom run bm25_top_lines /data/tables /data/out

A word that names no command is taken as the query of ``extract``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

COMMANDS = ("extract", "run")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lineloom")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("query")
    e.add_argument("file", nargs="?", help="a text file; standard input without one")
    e.add_argument("--pruner", default="bm25")
    r = sub.add_parser("run")
    r.add_argument("name")
    r.add_argument("tables")
    r.add_argument("out")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    bare = bool(argv) and argv[0] not in COMMANDS and not argv[0].startswith("-")
    return parser().parse_args(["extract", *argv] if bare else argv)


def extract(spark: SparkSession, query: str, text: str, pruner: str = "bm25") -> str:
    """The lines of a text that a pruner keeps for a query."""
    from .operators import rank

    df = spark.createDataFrame([(1, text, query)], "id long, text string, query string")
    got = rank.PRUNERS[pruner](df).select(F.array_join(rank.kept_lines(F.col("text"), F.col("kept")), "\n").alias("t")).first()
    return got.t


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("lineloom").getOrCreate()
    if args.command == "extract":
        if args.file:
            with open(args.file, encoding="utf-8") as f:
                text = f.read()
        else:
            text = sys.stdin.read()
        print(extract(spark, args.query, text, args.pruner))
        return 0
    from .plans import registry

    queries = registry.queries()
    if args.name not in queries:
        print(f"unknown query {args.name}", file=sys.stderr)
        return 2
    queries[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
