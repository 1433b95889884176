"""The log of pruning runs: times in several spellings, deliveries that repeat, totals and tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """A time as ISO text with or without fraction, 'T', zone or 'Z'; without a zone it is UTC. Null if it is no time."""
    return F.try_to_timestamp(_zoned(F.trim(text)))


def _zoned(text: Column) -> Column:
    t = F.regexp_replace(text, r"^(\d{4}-\d\d-\d\d) ", "$1T")
    return F.when(t.rlike(r"(?:Z|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z")))


def deliveries(log: DataFrame) -> DataFrame:
    """The first delivery of each entry: entries are equal but for log_id and received_at."""
    return log.groupBy("ts", "in_tokens", "out_tokens", "query").agg(F.min(F.struct("log_id", "received_at")).alias("_f")).select("_f.log_id", "ts", "in_tokens", "out_tokens", "query", "_f.received_at")


def totals() -> list[Column]:
    """Runs, tokens in and out, and the share saved (0 without any tokens in)."""
    a, b = F.coalesce(F.sum("in_tokens"), F.lit(0)), F.coalesce(F.sum("out_tokens"), F.lit(0))
    return [F.count("*").alias("runs"), a.cast("long").alias("in_tokens"), b.cast("long").alias("out_tokens"), F.round(F.when(a > 0, 1 - b / a).otherwise(0.0), 4).alias("saved")]


def entry(query: Column, original: Column, kept: Column) -> Column:
    """A log entry for one run; the query is cut at 80 characters, tokens are estimated."""
    from ..functions.text import tokens_of

    return F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"), tokens_of(original).alias("in_tokens"), tokens_of(kept).alias("out_tokens"), F.substring(query, 1, 80).alias("query"))
