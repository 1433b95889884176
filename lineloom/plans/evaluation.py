"""Queries that measure kept lines against gold ones, and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import WS
from ..operators import metrics as M
from ..operators import rank
from ..operators import spans as S
from ..runtime import ranked, table
from . import sql
from .registry import query

_NAMES = ("precision", "recall", "f1", "exact_match")


def examples(spark, sf_dir, pruner: str = "bm25"):
    """sample_id, tool_type, source, text, pred and ref: filled lines that a pruner kept, and the gold ones."""
    rows = table(spark, sf_dir, "canonical_rows").select(
        F.col("sample_id").alias("id"), "tool_type", "source", F.col("tool_output").alias("text"), "query", S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output"))).alias("spans")
    )
    got = rank.PRUNERS[pruner](rows)
    filled = lambda ls: F.filter(ls, lambda x: ~X.is_blank(x))
    return got.select(F.col("id").alias("sample_id"), "tool_type", "source", "text", filled(rank.kept_lines(F.col("text"), F.col("kept"))).alias("pred"), filled(S.extract(F.col("text"), F.col("spans"))).alias("ref"))


_EX = f"""{sql.BM25}, {sql.NORMAL},
pred as (select sample_id, list(line order by line_no) as pred from kept where not regexp_full_match(line, '{WS}*') group by sample_id),
ref as (select l.sample_id, list(line order by line_no) as ref from ({sql.LINES}) l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line where not regexp_full_match(line, '{WS}*') group by l.sample_id),
ex as (select c.sample_id, c.tool_type, c.source, c.tool_output, coalesce(pred, []) as pred, coalesce(ref, []) as ref from canonical_rows c left join pred using (sample_id) left join ref using (sample_id)),
m0 as (select *, len(list_distinct(pred)) as na, len(list_distinct(ref)) as nb, len(list_intersect(list_distinct(pred), list_distinct(ref)))::double as tp from ex),
m1 as (select *, case when na = 0 and nb = 0 then 1.0::double when na = 0 or nb = 0 then 0.0::double else tp / na end as p, case when na = 0 and nb = 0 then 1.0::double when na = 0 or nb = 0 then 0.0::double else tp / nb end as r from m0),
m as (select *, round(p, 4) as precision, round(r, 4) as recall, round(case when na = 0 and nb = 0 then 1.0::double when p + r > 0 then 2 * p * r / (p + r) else 0.0::double end, 4) as f1,
  case when na = 0 and nb = 0 then 1.0::double when tp = na and tp = nb then 1.0::double else 0.0::double end as exact_match,
  case when len(pred) = 0 and len(ref) = 0 then 'true_negative' when len(ref) = 0 then 'false_positive' when len(pred) = 0 then 'false_negative' else 'true_positive' end as category,
  round(1 - greatest(len(pred), 1)::double / len(string_split(tool_output, chr(10))), 4) as compression from m1)"""


@query(f"with {_EX} select sample_id, precision, recall, f1, exact_match from m")
def span_metrics(spark, sf_dir):
    m = M.span_metrics(F.col("pred"), F.col("ref"))
    return examples(spark, sf_dir).select("sample_id", *(m[k].alias(k) for k in _NAMES))


@query(f"with {_EX} select sample_id, category, compression from m")
def empty_accuracy(spark, sf_dir):
    ex = examples(spark, sf_dir)
    return ex.select("sample_id", M.empty_category(F.col("pred"), F.col("ref")).alias("category"), M.compression(F.col("text"), F.array_join("pred", "\n")).alias("compression"))


@query(f"with {_EX} select source, category, count(*) as n from m group by source, category")
def confusion(spark, sf_dir):
    ex = examples(spark, sf_dir).select("source", M.empty_category(F.col("pred"), F.col("ref")).alias("category"))
    return ex.groupBy("source", "category").agg(F.count("*").alias("n"))


@query("with " + _EX + ", long as (" + " union all ".join(f"select '{k}' as metric, {k} as value from m" for k in (*_NAMES, "compression")) + f") select metric, {sql.STATS.format('value')} from long group by metric")
def metric_summary(spark, sf_dir):
    """Count, mean, median, deviation and range of every measure."""
    m = M.span_metrics(F.col("pred"), F.col("ref"))
    ex = examples(spark, sf_dir).select(*(m[k].alias(k) for k in _NAMES), M.compression(F.col("text"), F.array_join("pred", "\n")).alias("compression"))
    long = ex.unpivot([], list(ex.columns), "metric", "value")
    return long.groupBy("metric").agg(*M.summary("value"))


@query()
def fuzzy_metrics(spark, sf_dir):
    """Measures that compare all pairs of lines: greedy fuzzy matching, partial cover, ROUGE-L."""
    return M.fuzzy_metrics(examples(spark, sf_dir), "sample_id")


def _pruned(name: str, rank_sql: str) -> str:
    return f"""select sample_id, '{name}' as pruner, line_no, line from (select *, row_number() over (partition by sample_id order by {rank_sql}) as rk, count(*) over (partition by sample_id) as n from ({sql.LINES})) where rk <= greatest(1, cast(floor(n * 0.1::double) as integer))"""


@query(f"""with {sql.BM25}, {sql.NORMAL}, kp as (select sample_id, 'bm25' as pruner, line_no, line from kept union all {_pruned('first', 'line_no')} union all {_pruned('last', '-line_no')} union all {_pruned('hash', "md5('42|' || sample_id || '|' || line_no), line_no")}),
pred as (select sample_id, pruner, list(distinct line) as pred from kp where not regexp_full_match(line, '{WS}*') group by sample_id, pruner),
ref as (select l.sample_id, list(distinct line) as ref from ({sql.LINES}) l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line where not regexp_full_match(line, '{WS}*') group by l.sample_id),
ex as (select c.tool_type, u.pruner, coalesce(pred, []) as pred, coalesce(ref, []) as ref from canonical_rows c cross join (values ('bm25'), ('first'), ('last'), ('hash')) as u(pruner) left join pred on pred.sample_id = c.sample_id and pred.pruner = u.pruner left join ref on ref.sample_id = c.sample_id),
m0 as (select *, len(pred) as na, len(ref) as nb, len(list_intersect(pred, ref))::double as tp from ex),
m1 as (select *, case when na = 0 and nb = 0 then 1.0::double when na = 0 or nb = 0 then 0.0::double else tp / na end as p, case when na = 0 and nb = 0 then 1.0::double when na = 0 or nb = 0 then 0.0::double else tp / nb end as r from m0)
select tool_type, pruner, count(*) as n, round(avg(round(p, 4)) + 1e-9, 4) as precision, round(avg(round(r, 4)) + 1e-9, 4) as recall, round(avg(round(case when na = 0 and nb = 0 then 1.0::double when p + r > 0 then 2 * p * r / (p + r) else 0.0::double end, 4)) + 1e-9, 4) as f1,
round(avg(case when (na = 0 and nb = 0) or (tp = na and tp = nb) then 1.0::double else 0.0::double end) + 1e-9, 4) as exact_match from m1 group by tool_type, pruner""")
def pruner_comparison(spark, sf_dir):
    """Mean measures of every registered pruner by tool type; the small addend makes halves round up in any order of summing."""
    m = M.span_metrics(F.col("pred"), F.col("ref"))
    out = None
    for name in sorted(rank.PRUNERS):
        got = examples(spark, sf_dir, name).select("tool_type", *(m[k].alias(k) for k in _NAMES)).groupBy("tool_type").agg(F.count("*").alias("n"), *(F.round(F.avg(k) + 1e-9, 4).alias(k) for k in _NAMES)).withColumn("pruner", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"with {sql.NORMAL}, k as (select sample_id, sum(end_line - start_line + 1) as kept from normal group by sample_id), r as (select tool_type, source, round(1 - coalesce(kept, 0) / len(string_split(tool_output, chr(10))), 4) as ratio, (kept is null)::integer as is_empty from canonical_rows left join k using (sample_id)) select tool_type, count(*) as n, round(avg(is_empty), 4) as empty_share, round(avg(ratio), 4) as mean_ratio, round(avg((ratio between 0.70 and 0.95)::integer), 4) as in_target from r group by tool_type")
def tool_stats(spark, sf_dir):
    """Per tool type: rows, share without relevant lines, mean compression, share in the target range."""
    n = S.n_lines(F.col("tool_output"))
    spans = S.normalise(F.col("gold_spans"), n)
    rows = table(spark, sf_dir, "canonical_rows").select("tool_type", (F.size(spans) == 0).cast("int").alias("is_empty"), F.round(1 - S.covered_lines(spans) / n, 4).alias("ratio"))
    return rows.groupBy("tool_type").agg(F.count("*").alias("n"), F.round(F.avg("is_empty"), 4).alias("empty_share"), F.round(F.avg("ratio"), 4).alias("mean_ratio"), F.round(F.avg(F.col("ratio").between(0.70, 0.95).cast("int")), 4).alias("in_target"))


@query(f"select source, tool_type, {sql.STATS.format('length(tool_output)')}, count(distinct instance_id) as instances from canonical_rows group by source, tool_type")
def length_report(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows").select("source", "tool_type", "instance_id", F.length("tool_output").cast("long").alias("size"))
    return rows.groupBy("source", "tool_type").agg(*M.summary("size"), F.count_distinct("instance_id").alias("instances"))


@query("select tool_type, count(*) as n, rank() over (order by count(*) desc, tool_type) as place from canonical_rows group by tool_type")
def group_counts(spark, sf_dir):
    from pyspark.sql import Window as W

    by = table(spark, sf_dir, "canonical_rows").groupBy("tool_type").agg(F.count("*").alias("n"))
    return by.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "tool_type")).cast("long"))


@query(f"with {sql.NORMAL}, e as (select sample_id from normal group by sample_id), a as (select tool_type, avg((is_irrelevant = (e.sample_id is null))::integer) as agreement from canonical_rows c left join e using (sample_id) group by tool_type having avg((is_irrelevant = (e.sample_id is null))::integer) >= 0.98) select c.sample_id, c.tool_type, round(a.agreement, 4) as agreement from canonical_rows c join a using (tool_type)")
def group_having(spark, sf_dir):
    """All rows of the tool types whose is_irrelevant agrees with the spans in 98% of rows."""
    none = F.size(S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output")))) == 0
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", "tool_type", (F.col("is_irrelevant") == none).cast("int").alias("agrees"))
    good = rows.groupBy("tool_type").agg(F.avg("agrees").alias("agreement")).where("agreement >= 0.98")
    return rows.join(good, "tool_type").select("sample_id", "tool_type", F.round("agreement", 4).alias("agreement"))


@query("""with t as (select count(*) as total_samples, count(*) filter (where split_name = 'train') as train_samples, count(*) filter (where split_name in ('dev', 'test')) as eval_samples, count(distinct instance_id) as unique_instances,
count(*) filter (where length(tool_output) > 50000) as long_outputs, count(*) filter (where len(gold_spans) = 0) as empty_spans from canonical_rows)
select *, round(train_samples / total_samples, 4) as train_share, (select string_agg(x, ',' order by x) from (select unnest(['read_file', 'grep', 'git_log', 'test_output', 'git_diff', 'sql_explain']) as x) where x not in (select tool_type from canonical_rows)) as missing_tools from t""")
def validation_report(spark, sf_dir):
    """One row: sizes, split balance, warnings, and expected tool types that are missing."""
    rows = table(spark, sf_dir, "canonical_rows")
    expected = F.array(*(F.lit(x) for x in ("read_file", "grep", "git_log", "test_output", "git_diff", "sql_explain")))
    got = rows.agg(
        F.count("*").alias("total_samples"), F.count_if(F.col("split_name") == "train").alias("train_samples"), F.count_if(F.col("split_name").isin("dev", "test")).alias("eval_samples"),
        F.count_distinct("instance_id").alias("unique_instances"), F.count_if(F.length("tool_output") > 50000).alias("long_outputs"), F.count_if(F.size("gold_spans") == 0).alias("empty_spans"), F.collect_set("tool_type").alias("there"),
    )
    missing = F.array_sort(F.array_except(expected, "there"))
    return got.withColumn("train_share", F.round(F.col("train_samples") / F.col("total_samples"), 4)).withColumn("missing_tools", F.when(F.size(missing) > 0, F.array_join(missing, ","))).drop("there")


@query(f"with {_EX}, picked as (select sample_id, tool_type, f1, exact_match, compression, category from m where (f1 < 0.5 or category in ('false_positive', 'false_negative')) and contains(lower(concat_ws(chr(10), sample_id, tool_type, source, category, list_aggregate(pred, 'string_agg', chr(10)), list_aggregate(ref, 'string_agg', chr(10)))), 'error')) select sample_id, tool_type, f1, category, row_number() over (order by f1, compression desc, sample_id) as place from picked")
def review_filter_sort(spark, sf_dir):
    """Weak or wrongly empty predictions that mention errors, worst first."""
    m = M.span_metrics(F.col("pred"), F.col("ref"))
    ex = examples(spark, sf_dir).withColumns({"f1": m["f1"], "category": M.empty_category(F.col("pred"), F.col("ref")), "compression": M.compression(F.col("text"), F.array_join("pred", "\n"))})
    text = F.lower(F.concat_ws("\n", F.col("sample_id").cast("string"), "tool_type", "source", "category", F.array_join("pred", "\n"), F.array_join("ref", "\n")))
    got = ex.where(((F.col("f1") < 0.5) | F.col("category").isin("false_positive", "false_negative")) & text.contains("error"))
    got = ranked(got.select("sample_id", "tool_type", "f1", "category", "compression"), F.col("f1"), -F.col("compression"), F.col("sample_id"), name="k")
    return got.select("sample_id", "tool_type", "f1", "category", (F.col("k") + 1).alias("place"))
