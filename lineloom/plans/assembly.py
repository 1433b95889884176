"""Queries that build, split and extend datasets, and audit them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import WS
from ..operators import audit as A
from ..operators import dataset as D
from ..operators import spans as S
from ..runtime import table
from ..sources import tables as T
from . import sql
from .registry import query

_REL = f"{sql.NORMAL}, rel as (select l.sample_id, string_agg(line, chr(10) order by line_no) as body, count(*) as n_rel, count(distinct line) as n_distinct from ({sql.LINES}) l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line group by l.sample_id)"


@query(f"with {sql.NORMAL}, k as (select sample_id, string_agg(start_line || '-' || end_line, ',' order by start_line) as spans from normal group by sample_id) select sample_id, coalesce(spans, '') as spans, coalesce(is_irrelevant, spans is null) as is_irrelevant from canonical_rows left join k using (sample_id)")
def canonical(spark, sf_dir):
    rows = D.canonical(table(spark, sf_dir, "canonical_rows"))
    return rows.select("sample_id", F.array_join(F.transform("gold_spans", lambda s: F.concat_ws("-", s["start_line"], s["end_line"])), ",").alias("spans"), "is_irrelevant")


@query(f"""with {_REL} select sample_id, instance_id, tool_type, source,
md5('<|im_start|>system' || chr(10) || 'You prune verbose tool output for a coding agent. Given a focused extraction query and one tool output, return only the smallest verbatim evidence block(s) the agent should read next. Return the kept text inside <relevant_lines> tags. Do not rewrite, summarize, or invent lines.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<query>' || chr(10) || (case when length(query) > 1000 then left(query, 1000) || '...' else query end) || chr(10) || '</query>' || chr(10)
 || (case when coalesce(background_task, '') <> '' then '<background_task>' || chr(10) || (case when length(background_task) > 3000 then left(background_task, 3000) || '...' else background_task end) || chr(10) || '</background_task>' || chr(10) else '' end)
 || '<tool_output>' || chr(10) || tool_output || chr(10) || '</tool_output><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) as prompt,
case when n_rel > 0 then '<relevant_lines>' || chr(10) || body || chr(10) || '</relevant_lines>' else '<relevant_lines>' || chr(10) || '</relevant_lines>' end as response,
len(string_split(tool_output, chr(10)))::bigint as num_total_lines, coalesce(n_rel, 0)::bigint as num_relevant_lines, round(1 - coalesce(n_rel, 0) / len(string_split(tool_output, chr(10))), 4) as compression_ratio
from canonical_rows left join rel using (sample_id) where query <> '' and tool_output <> ''""")
def sft_view(spark, sf_dir):
    got = D.sft(D.canonical(table(spark, sf_dir, "canonical_rows")))
    return got.withColumn("prompt", F.md5("prompt"))


@query(f"with {_REL} select sample_id, query as task, md5(tool_output) as tool_output, coalesce(body, '') as relevant, tool_type from canonical_rows left join rel using (sample_id) where query <> '' and tool_output <> ''")
def encoder_view(spark, sf_dir):
    got = D.encoder(D.canonical(table(spark, sf_dir, "canonical_rows")))
    return got.select("sample_id", "task", F.md5("tool_output").alias("tool_output"), F.array_join("relevant_lines", "\n").alias("relevant"), "tool_type")


@query("select sample_id, query, coalesce(background_task, '') as background, md5(tool_output) as output from canonical_rows where query <> '' and tool_output <> ''")
def prompt_parse(spark, sf_dir):
    """Prompts are taken apart again; nothing is lost."""
    rows = table(spark, sf_dir, "canonical_rows").where("query <> '' and tool_output <> ''")
    p = D.parse_prompt(F.col("prompt"))
    got = rows.select("sample_id", D.prompt(F.col("query"), F.col("tool_output"), F.col("background_task"), None, None).alias("prompt"))
    return got.select("sample_id", p["query"].alias("query"), p["background"].alias("background"), F.md5(p["output"]).alias("output"))


@query("select sample_id, 'system,user' as roles, 'You prune verbose tool output for a coding agent. Given a focused extraction query and one tool output, return only the smallest verbatim evidence block(s) the agent should read next. Return the kept text inside <relevant_lines> tags. Do not rewrite, summarize, or invent lines.' as instruction, md5((case when coalesce(query, '') <> '' then '<query>' || chr(10) || (case when length(query) > 3000 then left(query, 3000) || '...' else query end) || chr(10) || '</query>' || chr(10) else '' end) || '<tool_output>' || chr(10) || tool_output || chr(10) || '</tool_output>') as content from canonical_rows")
def chat_messages(spark, sf_dir):
    m = D.messages(F.col("query"), F.col("tool_output"))
    return table(spark, sf_dir, "canonical_rows").select("sample_id", m.alias("m")).select("sample_id", F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.get("m", F.lit(0))["content"].alias("instruction"), F.md5(F.get("m", F.lit(1))["content"]).alias("content"))


@query(f"with {_REL} select sample_id, coalesce(list_aggregate(list_filter(list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), 'string_agg', chr(10)), '') as parsed from canonical_rows left join rel using (sample_id) where query <> '' and tool_output <> '' and not contains(coalesce(body, ''), 'relevant_lines>')")
def reply_parse(spark, sf_dir):
    """Relevant lines of the assembled responses, parsed again."""
    got = D.sft(D.canonical(table(spark, sf_dir, "canonical_rows")))
    return got.select("sample_id", F.array_join(D.parse_lines(F.col("response")), "\n").alias("parsed"))


@query("with j as (select 'Sure: ' || '{\"relevant_lines\": [\"' || source || '\", \"' || tool_type || '\"], \"n\": ' || sample_id || '}' as reply, * from canonical_rows) select sample_id, source || ',' || tool_type as items, sample_id as n from j")
def json_salvage(spark, sf_dir):
    """The object in a reply with words before it and, for every other row, a fence around it."""
    rows = table(spark, sf_dir, "canonical_rows")
    obj = F.concat(F.lit('{"relevant_lines": ["'), "source", F.lit('", "'), "tool_type", F.lit('"], "n": '), F.col("sample_id").cast("string"), F.lit("}"))
    reply = F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), obj, F.lit(" I hope so")))
    got = rows.select("sample_id", X.salvage_json(reply, "relevant_lines array<string>, n bigint").alias("j"))
    return got.select("sample_id", F.array_join("j.relevant_lines", ",").alias("items"), F.col("j.n").alias("n"))


@query("select doc_id, regexp_extract(text, '(?s)<h2>\\s*\\n?(.*?)\\n?\\s*</h2>', 1) as heading from documents where contains(text, '<h2>')")
def tag_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").contains("<h2>")).select("doc_id", X.tag(F.col("text"), "h2").alias("heading"))


@query("select instance_id, case when contains(instance_id, '-') then regexp_extract(instance_id, '(?s)^(.*)-[^-]*$', 1) else instance_id end as repo, 'https://api.github.com/repos/' || repo || '/issues' || case when regexp_matches(instance_id, '-\\d+$') then '/' || regexp_extract(instance_id, '-(\\d+)$', 1) else '?per_page=5&state=all' end as url from instances")
def repo_of(spark, sf_dir):
    i = table(spark, sf_dir, "instances")
    return i.select("instance_id", X.repo_of(F.col("instance_id")).alias("repo"), X.issue_url(F.col("instance_id"), F.col("repo")).alias("url"))


@query("""with p as (select *, coalesce(split_group_id, instance_id) as group_id from canonical_rows where source <> 'swe'), g as (select distinct tool_type, group_id from p where source = 'synthetic'),
r as (select *, row_number() over (partition by tool_type order by md5('42|' || group_id), group_id) as rk, count(*) over (partition by tool_type) as n from g),
s as (select tool_type, group_id, case when rk <= greatest(1, floor(n * 0.1::double)) then 'test' when rk <= greatest(1, floor(n * 0.1::double)) + greatest(1, floor(n * 0.05::double)) then 'dev' else 'train' end as split_name from r),
c as (select tool_type, min(sample_id) as came from p where source = 'synthetic' group by tool_type), b as (select group_id, arg_max(split_name, came) as split_name from s join c using (tool_type) group by group_id)
select sample_id, s.split_name from p join s using (tool_type, group_id) where source = 'synthetic' union all select sample_id, coalesce(b.split_name, 'train') from p left join b using (group_id) where source = 'synthetic_negative'""")
def group_split(spark, sf_dir):
    """Made rows by hashed rank of their group in its tool type; negatives follow the group of their output, train without one."""
    rows = table(spark, sf_dir, "canonical_rows").where("source <> 'swe'").select("sample_id", "source", "tool_type", F.coalesce("split_group_id", "instance_id").alias("group_id"))
    return D.made_splits(rows)


@query("""with pos as (select sample_id, tool_type, query from canonical_rows where source <> 'synthetic_negative'), size as (select greatest(1, floor(count(*) * 0.15::double)::integer) as n from pos),
o as (select sample_id as output_id, tool_type as output_tool, row_number() over (order by md5('42|' || sample_id), sample_id) - 1 as k from pos qualify k < (select n from size)),
a as (select sample_id as query_id, tool_type as query_tool, query, row_number() over (order by md5('43|' || sample_id), sample_id) - 1 as q from pos),
t as (select o.*, a.*, a.q - o.k as try from o join a on a.q between o.k and o.k + 9 and a.q < (select n from size) + 10 where a.query_tool <> o.output_tool and a.query_id <> o.output_id)
select output_id, output_tool, query_id, query_tool, query from t qualify row_number() over (partition by output_id order by try) = 1""")
def negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows").where("source <> 'synthetic_negative'").select("sample_id", "tool_type", "query")
    return D.negatives(rows)


@query("select instance_id, command, arg_max(query, call_seq) as query, arg_max(tool_type, call_seq) as tool_type, max(call_seq) as call_seq from tool_calls group by instance_id, command")
def latest_calls(spark, sf_dir):
    """Of calls with one instance and command the later one holds."""
    calls = table(spark, sf_dir, "tool_calls").select("instance_id", "command", "query", "tool_type", "call_seq").withColumn("seq", F.col("call_seq"))
    return D.latest(calls, ["instance_id", "command"], "seq").drop("seq")


@query("with last as (select instance_id, command, arg_max(query, call_seq) as task from tool_calls group by instance_id, command) select c.sample_id, coalesce(nullif(c.background_task, ''), nullif(l.task, ''), c.query) as task, l.task is not null as was_called from canonical_rows c left join last l on l.instance_id = c.instance_id and l.command = c.command")
def task_fill(spark, sf_dir):
    """Each row's own background, else the query of its latest call, else its query."""
    calls = table(spark, sf_dir, "tool_calls").groupBy("instance_id", "command").agg(F.max_by("query", "call_seq").alias("task"))
    rows = table(spark, sf_dir, "canonical_rows").join(calls, ["instance_id", "command"], "left")
    return rows.select("sample_id", X.first_filled(F.col("background_task"), F.col("task"), F.col("query")).alias("task"), F.col("task").isNotNull().alias("was_called"))


@query("select call_seq, instance_id, tool_type from tool_calls t where not exists (select 1 from canonical_rows c where c.instance_id is not distinct from t.instance_id and c.command is not distinct from t.command)")
def resume_anti(spark, sf_dir):
    """Calls that no row has the output of."""
    done = table(spark, sf_dir, "canonical_rows")
    return T.unfinished(table(spark, sf_dir, "tool_calls"), done, ["instance_id", "command"]).select("call_seq", "instance_id", "tool_type")


@query("select c.sample_id, i.base_commit, i.version from canonical_rows c join instances i using (instance_id)")
def instance_join(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", "instance_id")
    return rows.join(table(spark, sf_dir, "instances").select("instance_id", "base_commit", "version"), "instance_id").select("sample_id", "base_commit", "version")


@query("select c.sample_id, coalesce(i.base_commit, 'HEAD') as base_commit, i.instance_id is not null as known from canonical_rows c left join instances i using (instance_id) where c.source = 'swe'")
def instance_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows").where("source = 'swe'").select("sample_id", "instance_id")
    i = table(spark, sf_dir, "instances").select("instance_id", "base_commit", F.lit(True).alias("k"))
    return rows.join(i, "instance_id", "left").select("sample_id", F.coalesce("base_commit", F.lit("HEAD")).alias("base_commit"), F.coalesce("k", F.lit(False)).alias("known"))


@query("select 'row' as kind, sample_id as id, tool_type, query, command, null::varchar as url from canonical_rows union all select 'call', call_seq, tool_type, query, command, url from tool_calls")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "canonical_rows").select(F.lit("row").alias("kind"), F.col("sample_id").alias("id"), "tool_type", "query", "command")
    b = table(spark, sf_dir, "tool_calls").select(F.lit("call").alias("kind"), F.col("call_seq").alias("id"), "tool_type", "query", "command", "url")
    return a.unionByName(b, allowMissingColumns=True)


@query("select tool_type, samples, len(scenarios)::bigint as n_scenarios, (select max(length(e.tool_output)) from (select unnest(seed_examples) as e))::bigint as longest_seed from tool_configs where tool_type not in (select tool_type from canonical_rows) or samples > 0 or samples is null")
def configured_tools(spark, sf_dir):
    c = table(spark, sf_dir, "tool_configs")
    return c.select("tool_type", "samples", F.size("scenarios").cast("long").alias("n_scenarios"), F.array_max(F.transform("seed_examples", lambda e: F.length(e["tool_output"]))).cast("long").alias("longest_seed")).withColumn("n_scenarios", F.when(F.col("n_scenarios") >= 0, F.col("n_scenarios")))


_BAD = " or ".join(f"(tool_type = '{k}' and (" + " or ".join(f"contains(q, '{m}')" for m in v) + "))" for k, v in A.FORBIDDEN.items())


@query(f"with t as (select sample_id, tool_type, lower(regexp_replace(query, '^{WS}+|{WS}+$', '', 'g')) as q from canonical_rows) select sample_id, not (q = '' or contains(q, 'all lines containing') or (starts_with(q, 'find the import statement') and tool_type <> 'read_file') or {_BAD} or (tool_type in ('type_check', 'python', 'build_output', 'pip_install', 'test_output') and contains(q, 'code block') and (contains(q, 'class') or contains(q, 'function') or contains(q, 'method') or contains(q, 'import')))) as compatible from t")
def query_compat(spark, sf_dir):
    return table(spark, sf_dir, "canonical_rows").select("sample_id", A.compatible(F.col("tool_type"), F.col("query")).alias("compatible"))


_AUDIT = f"""{sql.NORMAL}, l as ({sql.LINES}),
raw as (select sample_id, sp.start_line as a, sp.end_line as b, p from (select sample_id, unnest(gold_spans) as sp, generate_subscripts(gold_spans, 1) as p from canonical_rows)),
lines as (select l.sample_id, l.line from l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line),
rel as (select sample_id, count(*) as n_rel, count(distinct line) as n_dist from lines group by sample_id),
filled as (select sample_id, count(*) filter (where not regexp_full_match(line, '{WS}*')) as n_filled from l group by sample_id),
same as (select c.sample_id, coalesce((select string_agg(a || '-' || b, ',' order by p) from raw where raw.sample_id = c.sample_id), '') as as_is, coalesce((select string_agg(start_line || '-' || end_line, ',' order by start_line) from normal where normal.sample_id = c.sample_id), '') as merged from canonical_rows c),
checks as (select c.sample_id, c.tool_type, n_filled, coalesce(n_rel, 0) as n_rel, coalesce(n_rel, 0) - coalesce(n_dist, 0) as dup,
 list_filter([case when as_is <> merged and len(gold_spans) > 0 then 'gold_spans_not_normalized' end, case when length(query) < 10 then 'task_too_short' end, case when length(tool_output) < 20 then 'tool_output_too_short' end,
 case when coalesce(n_rel, 0) > coalesce(n_dist, 0) then 'duplicate_relevant_lines' end, case when n_filled > 0 and n_rel > 0 and n_rel / n_filled > 0.5 then 'high_relevant_ratio' end], lambda x: x is not null) as issues from canonical_rows c join filled using (sample_id) join same using (sample_id) left join rel using (sample_id))"""


@query(f"with {_AUDIT} select sample_id, tool_type, case when len(issues) = 0 then 'pass' else 'fail' end as status, coalesce(list_aggregate(issues, 'string_agg', ','), '') as issues, n_filled as n_output_lines, n_rel as n_relevant_lines, dup as duplicate_count from checks")
def qa_audit(spark, sf_dir):
    return A.audit(table(spark, sf_dir, "canonical_rows")).withColumn("issues", F.array_join("issues", ","))


@query(f"with {_AUDIT} select issue, count(*) as n from (select unnest(issues) as issue from checks) group by issue")
def qa_issue_counts(spark, sf_dir):
    return A.audit(table(spark, sf_dir, "canonical_rows")).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"with {_AUDIT} select tool_type, count(*) as n, count(*) filter (where len(issues) = 0) as passed, count(*) filter (where len(issues) > 0) as failed, round(avg((len(issues) = 0)::integer), 4) as pass_rate from checks group by tool_type")
def qa_by_tool(spark, sf_dir):
    a = A.audit(table(spark, sf_dir, "canonical_rows"))
    ok = F.col("status") == "pass"
    return a.groupBy("tool_type").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("int")), 4).alias("pass_rate"))


@query("""with r as (select tool_type, sample_id, row_number() over (partition by tool_type order by md5('42|' || sample_id), sample_id) as rk, count(*) over (partition by tool_type) as n from canonical_rows) select tool_type, sample_id from r where rk <= greatest(1, floor(n * 0.1::double))""")
def audit_sample(spark, sf_dir):
    """A tenth of every tool type, one row at least, by hashed rank."""
    from pyspark.sql import Window as W

    by = W.partitionBy("tool_type")
    rows = table(spark, sf_dir, "canonical_rows").select("tool_type", "sample_id")
    rows = rows.withColumn("rk", F.row_number().over(by.orderBy(D.order_key(42, F.col("sample_id")), "sample_id"))).withColumn("n", F.count("*").over(by))
    return rows.where(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("n").cast("double") * F.lit(0.1)))).select("tool_type", "sample_id")
