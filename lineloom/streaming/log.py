"""Structured Streaming over observations and the session log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import rank, sessions
from ..operators import spans as S


def source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def savings(log: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Runs, tokens and deliveries per tumbling window of the entry's own time.

    Entries may come up to ``late`` after the newest one; entries delivered again within that time are dropped, so
    state is bounded by it. Entries without a readable time are left out.
    """
    rows = log.withColumn("at", sessions.instant(F.col("ts"))).where("at is not null").withWatermark("at", late)
    rows = rows.dropDuplicates(["at", "in_tokens", "out_tokens", "query"])
    by = rows.groupBy(F.window("at", window).alias("w")).agg(F.count("*").alias("runs"), F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("in_tokens"), F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("out_tokens"))
    return by.select(F.col("w.start").alias("start"), "runs", "in_tokens", "out_tokens")


def prune(observations: DataFrame, pruner: str = "bm25") -> DataFrame:
    """id, kept lines as runs, of every observation (id, text, query); stateless, so it streams as it batches."""
    return rank.PRUNERS[pruner](observations).select("id", rank.islands(F.col("kept")).alias("spans"), F.array_join(S.extract(F.col("text"), rank.islands(F.col("kept"))), "\n").alias("kept_text"))


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything available now, to files; a second run goes on where the first one ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
