"""Session helpers shared by all operators: checkpoints, table access, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as ``spark.checkpoint.dir`` names it.

    Only on one machine (a local master), where that is unset, a temporary folder is made, and deleted at exit; on a
    cluster tasks elsewhere couldn't read such a folder, so there an unset one is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            current = tempfile.mkdtemp(prefix="lineloom-checkpoint-")
            atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
    return current


def stable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder; later reads survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most rows a side may have to be broadcast by :func:`small_enough`.
BROADCAST_ROWS = 100_000


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows (reads no more than ``limit + 1``)."""
    return df.limit(limit + 1).count() <= limit


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Adds the position (from 0) of every row in the whole order, without a sort in one task.

    Rows are range-partitioned and sorted; the sizes of the partitions before a row's own, one number each, give its
    offset. The order must be total, or the positions of equal rows may differ between runs.
    """
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    placed = stable(placed.repartitionByRange(parts, *keys).withColumn("_p", F.spark_partition_id()))
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # a number for each partition
    offset, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, offset))
        offset += sizes[p]
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _before long")
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*keys))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + inside - 1).drop("_p", "_before", *(f"_o{i}" for i in range(len(order))))


def head_by_hash(df: DataFrame, digest: str, n: int) -> DataFrame:
    """At least the ``n`` rows whose hexadecimal ``digest`` (a column) comes first, and few more, without a sort.

    Rows are counted in 65,536 steps of the first four digits; all up to the step that holds the n-th are given.
    """
    from pyspark.sql import functions as F

    step = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    upto = 0
    for r in sorted(df.groupBy(step.alias("step")).count().collect()):  # at most 65,536 numbers
        upto += r["count"]
        if upto >= n:
            return df.where(step <= r["step"])
    return df
