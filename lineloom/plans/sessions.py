"""Queries over the session log and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as O
from ..runtime import table
from .registry import query

_LOG = "entries as (select min(log_id) as log_id, ts, in_tokens, out_tokens, query, (case when regexp_matches(ts, '(Z|[+-][0-9]{2}:?[0-9]{2})$') then ts else ts || 'Z' end)::timestamptz at time zone 'UTC' as moment from session_log group by ts, in_tokens, out_tokens, query)"


@query("select count(*) as runs, coalesce(sum(in_tokens), 0)::bigint as in_tokens, coalesce(sum(out_tokens), 0)::bigint as out_tokens, round(case when coalesce(sum(in_tokens), 0) > 0 then 1 - coalesce(sum(out_tokens), 0) / sum(in_tokens) else 0 end, 4) as saved from (select distinct ts, in_tokens, out_tokens, query from session_log)")
def session_summary(spark, sf_dir):
    return O.deliveries(table(spark, sf_dir, "session_log")).agg(*O.totals())


@query(f"with {_LOG} select strftime(date_trunc('day', moment), '%Y-%m-%d') as day, count(*) as runs, coalesce(sum(in_tokens), 0)::bigint as in_tokens, coalesce(sum(out_tokens), 0)::bigint as out_tokens, round(case when coalesce(sum(in_tokens), 0) > 0 then 1 - coalesce(sum(out_tokens), 0) / sum(in_tokens) else 0 end, 4) as saved from entries group by day")
def session_days(spark, sf_dir):
    log = O.deliveries(table(spark, sf_dir, "session_log")).withColumn("at", O.instant(F.col("ts")))
    return log.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(*O.totals())


@query(f"with {_LOG} select log_id, epoch_us(moment)::bigint as micros, left(query, 80) as query from entries")
def session_entries(spark, sf_dir):
    log = O.deliveries(table(spark, sf_dir, "session_log"))
    return log.select("log_id", F.unix_micros(O.instant(F.col("ts"))).alias("micros"), F.substring("query", 1, 80).alias("query"))


@query("select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(distinct user_id) as users, round(sum(cast(json_extract(props, '$.k') as bigint)), 4)::bigint as k from events group by event_type, day")
def event_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("k").alias("k"))
