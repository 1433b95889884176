"""Queries over patches and the labels they give to tool output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import WS
from ..operators import calls as C
from ..operators import patches as P
from ..runtime import table
from . import sql
from .registry import query

_PATCH = """pl as (select instance_id, unnest(string_split(patch, chr(10))) as line, generate_subscripts(string_split(patch, chr(10)), 1) as i from instances),
pf as (select instance_id, i, case when starts_with(line, 'diff --git') then case when len(string_split(line, ' b/')) = 2 then trim(string_split(line, ' b/')[2]) end when starts_with(line, '+++ b/') and trim(line[7:]) <> '/dev/null' then trim(line[7:]) end as file from pl),
files as (select instance_id, file, min(i) as i from pf where file is not null group by instance_id, file),
cur as (select *, max(case when starts_with(line, '+++ b/') then i end) over (partition by instance_id order by i) as fi from pl),
hk as (select c.instance_id, c.i, trim(f.line[7:]) as file, regexp_extract(c.line, '^@@ [^+]*\\+(\\d+(?:,\\d+)?) [^@]*@@', 1) as part from cur c join pl f on f.instance_id = c.instance_id and f.i = c.fi where starts_with(c.line, '@@ ')),
hunks as (select instance_id, i, file, string_split(part, ',')[1]::integer as start, (string_split(part, ',')[1]::integer + coalesce(string_split(part, ',')[2]::integer, 1) - 1)::integer as stop from hk where part <> ''),
nm as (select distinct instance_id, unnest(regexp_extract_all(patch, 'def (\\w+)', 1) || regexp_extract_all(patch, 'class (\\w+)', 1)) as name from instances)"""


@query(f"with {_PATCH} select instance_id, file, row_number() over (partition by instance_id order by i)::integer as place from files")
def patch_files(spark, sf_dir):
    i = table(spark, sf_dir, "instances").select("instance_id", F.posexplode(P.files(F.col("patch"))).alias("place", "file"))
    return i.select("instance_id", "file", (F.col("place") + 1).alias("place"))


@query(f"with {_PATCH} select instance_id, file, start, stop from hunks")
def patch_hunks(spark, sf_dir):
    return table(spark, sf_dir, "instances").select("instance_id", F.inline(P.hunks(F.col("patch"))))


@query(f"with {_PATCH} select instance_id, name from nm")
def patch_names(spark, sf_dir):
    return table(spark, sf_dir, "instances").select("instance_id", F.explode(P.names(F.col("patch"))).alias("name"))


@query(r"""with v as (select instance_id, list_sort(list_distinct(regexp_extract_all(patch, 'def (\w+)', 1))) as functions, list_sort(list_distinct(regexp_extract_all(patch, 'class (\w+)', 1))) as classes, list_sort(list_distinct(regexp_extract_all(patch, '["'']([A-Za-z_]\w{5,}(?:\s\w+){0,3})["'']', 1)))[1:5] as error_strings,
list_sort(list_distinct(regexp_extract_all(patch, '(\w{3,})\s*=', 1)))[1:10] as variables, list_sort(list_distinct(regexp_extract_all(problem_statement, '`([^`]{3,50})`', 1) || regexp_extract_all(problem_statement, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1)))[1:10] as issue_terms from instances)
select instance_id, coalesce(list_aggregate(functions, 'string_agg', ','), '') as functions, coalesce(list_aggregate(classes, 'string_agg', ','), '') as classes, coalesce(list_aggregate(error_strings, 'string_agg', ','), '') as error_strings, coalesce(list_aggregate(variables, 'string_agg', ','), '') as variables, coalesce(list_aggregate(issue_terms, 'string_agg', ','), '') as issue_terms from v""")
def identifiers(spark, sf_dir):
    i = table(spark, sf_dir, "instances")
    kinds = P.identifiers(F.col("patch")) | {"issue_terms": P.issue_terms(F.col("problem_statement"))}
    return i.select("instance_id", *(F.array_join(v, ",").alias(k) for k, v in kinds.items()))


_LABELS = f"""{_PATCH}, l as (select c.sample_id, c.instance_id, c.tool_type, x.line, x.line_no from canonical_rows c join ({sql.LINES}) x using (sample_id) where c.tool_type in ('grep', 'git_log', 'test_output', 'git_diff', 'ls', 'git_blame', 'lint_output', 'build_output') and c.instance_id in (select instance_id from instances)),
pi as (select instance_id, (select list(file) from files f where f.instance_id = i.instance_id) as files, (select list({{'f': file, 'a': start, 'b': stop}}) from hunks h where h.instance_id = i.instance_id) as hunks, (select list(name) from nm where nm.instance_id = i.instance_id) as names from instances i),
t as (select *, starts_with(line, 'FAIL:') or starts_with(line, 'ERROR:') as opens, starts_with(line, '---') as dashes from l),
m as (select *, max(case when opens then line_no end) over (partition by sample_id order by line_no) as last_open, max(case when dashes and not opens then line_no end) over (partition by sample_id order by line_no rows between unbounded preceding and 1 preceding) as last_dash from t),
lab8 as (select m.sample_id, m.tool_type, m.line_no, case m.tool_type
 when 'git_diff' then ((starts_with(line, '+') or starts_with(line, '-')) and not starts_with(line, '+++') and not starts_with(line, '---')) or starts_with(line, '@@') or starts_with(line, 'diff --git')
 when 'test_output' then opens or (last_open is not null and (last_dash is null or last_dash < last_open)) or contains(line, 'FAILED') or contains(line, 'Error')
 when 'git_log' then len(list_filter(coalesce(names, []), lambda n: contains(lower(line), lower(n)))) > 0
 when 'ls' then len(list_filter(coalesce(files, []), lambda f: contains(line, string_split(f, '/')[-1]))) > 0
 when 'grep' then regexp_matches(line, '^([^:]+):(\\d+):') and list_contains(coalesce(files, []), regexp_extract(line, '^([^:]+):(\\d+):', 1)) and
   (len(list_filter(coalesce(hunks, []), lambda h: h.f = regexp_extract(line, '^([^:]+):(\\d+):', 1))) = 0 or len(list_filter(coalesce(hunks, []), lambda h: h.f = regexp_extract(line, '^([^:]+):(\\d+):', 1) and try_cast(regexp_extract(line, '^([^:]+):(\\d+):', 2) as integer) between h.a - 10 and h.b + 10)) > 0)
 else len(list_filter(coalesce(files, []) || coalesce(names, []), lambda x: contains(line, x))) > 0 end as hit from m join pi on pi.instance_id = m.instance_id),
rf as (select c.sample_id, c.instance_id, x.line_no, case when regexp_matches(x.line, '^\\d+: (.*)$') then regexp_extract(x.line, '^\\d+: (.*)$', 1) else x.line end as ct, list_filter(coalesce(pi.hunks, []), lambda h: h.f = regexp_extract(command, '(\\S+)\\s*$', 1)) as own,
  list_contains(coalesce(pi.files, []), regexp_extract(command, '(\\S+)\\s*$', 1)) as touched, coalesce(pi.names, []) as names from canonical_rows c join pi using (instance_id) join ({sql.LINES}) x using (sample_id) where c.tool_type = 'read_file'),
rt as (select *, length(ct) - length(regexp_replace(ct, '^{WS}+', '')) as depth, regexp_matches(regexp_replace(ct, '^{WS}+', ''), '^(def |class )') as head, len(list_filter(own, lambda h: line_no between h.a and h.b)) > 0 as target from rf where touched or len(own) > 0),
hd as (select h.sample_id, h.line_no, h.depth, (select min(j.line_no) from rt j where j.sample_id = h.sample_id and j.head and j.line_no > h.line_no and j.depth <= h.depth) as stop from rt h where h.head),
enc as (select distinct hd.sample_id, hd.line_no from hd join rt t on t.sample_id = hd.sample_id and t.target and t.line_no > hd.line_no and (hd.stop is null or t.line_no < hd.stop) and t.depth > hd.depth),
lab as (select * from lab8 union all select rf.sample_id, 'read_file', rf.line_no, rt.line_no is not null and (rt.target or enc.line_no is not null or (regexp_matches(regexp_replace(rf.ct, '^{WS}+', ''), '^(import |from )') and len(list_filter(rf.names, lambda n: contains(regexp_replace(rf.ct, '^{WS}+|{WS}+$', '', 'g'), n))) > 0))
  from rf left join rt on rt.sample_id = rf.sample_id and rt.line_no = rf.line_no left join enc on enc.sample_id = rf.sample_id and enc.line_no = rf.line_no)"""


def _outputs(spark, sf_dir):
    return table(spark, sf_dir, "canonical_rows").select(F.col("sample_id").alias("id"), "instance_id", "tool_type", "command", F.col("tool_output").alias("text"))


@query(f"with {_LABELS} select sample_id, tool_type, line_no::integer as line_no from lab where hit")
def label_lines(spark, sf_dir):
    """Lines that the patch of the row's instance makes relevant, by the rules of nine tool types."""
    got = P.label(_outputs(spark, sf_dir), P.patch_table(table(spark, sf_dir, "instances")))
    return got.select(F.col("id").alias("sample_id"), "tool_type", F.posexplode("labels").alias("i", "hit")).where("hit").select("sample_id", "tool_type", (F.col("i") + 1).alias("line_no"))


@query(f"with {_LABELS}, n as (select sample_id, tool_type, count(*) as n_lines, count(*) filter (where hit) as n_relevant from lab group by sample_id, tool_type) select sample_id, tool_type, n_lines, n_relevant, round(n_relevant / n_lines, 4) as ratio from n where n_lines >= 10 and n_relevant >= 3 and n_relevant / n_lines between 0.02 and 0.40")
def label_gate(spark, sf_dir):
    got = P.label(_outputs(spark, sf_dir), P.patch_table(table(spark, sf_dir, "instances")))
    return P.quality_gate(got).withColumnRenamed("id", "sample_id")


@query(f"with {_LABELS} select sample_id, count(*)::integer as n_lines, count(*) filter (where hit)::integer as n_relevant from lab where tool_type = 'read_file' group by sample_id")
def label_files(spark, sf_dir):
    """Labels of files that were read: changed lines, definitions around them, imports of named things."""
    got = P.label(_outputs(spark, sf_dir).where("tool_type = 'read_file'"), P.patch_table(table(spark, sf_dir, "instances")))
    return got.select(F.col("id").alias("sample_id"), F.size("labels").alias("n_lines"), F.size(F.filter("labels", lambda x: x)).alias("n_relevant"))


@query("""with j as (select instance_id, trim(fail_to_pass) as t from instances), p as (select instance_id, unnest(case when t is null then []::varchar[] when starts_with(t, '[') then from_json(t, '["VARCHAR"]') else list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '') end) as test from j) select instance_id, test from p""")
def failing_tests(spark, sf_dir):
    """Names in a JSON list or a comma-separated one."""
    return table(spark, sf_dir, "instances").select("instance_id", F.explode(X.string_list(F.col("fail_to_pass"))).alias("test"))


@query(f"""with {_PATCH}, fs as (select instance_id, arg_min(file, i) as file from files group by instance_id), ids as (select instance_id, list_sort(list_distinct(regexp_extract_all(patch, 'def (\\w+)', 1)))[1] as f, list_sort(list_distinct(regexp_extract_all(patch, 'class (\\w+)', 1)))[1] as c,
 list_sort(list_distinct(regexp_extract_all(patch, '["'']([A-Za-z_]\\w{{5,}}(?:\\s\\w+){{0,3}})["'']', 1)))[1] as e, list_sort(list_distinct(regexp_extract_all(patch, '(\\w{{3,}})\\s*=', 1)))[1] as v from instances)
select instance_id, t.kind as tool_type, coalesce(f, c, e, v, replace(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', ''), '_', ' '), 'the relevant bug behavior') as focus, t.head || focus || t.tail as query from ids left join fs using (instance_id), (values
('read_file', 'Find the code block most relevant to how ', ' is handled.'), ('grep', 'Find the grep hits most relevant to how ', ' is handled.'), ('git_log', 'Find the commit entry most relevant to ', '.'), ('git_diff', 'Find the diff hunk most relevant to how ', ' changes.'), ('git_blame', 'Find the blame block most relevant to ', '.'),
('ls', 'Find the directory entries most relevant to ', '.'), ('test_output', 'Find the failure block most relevant to ', '.'), ('build_output', 'Find the failure block most relevant to ', '.'), ('lint_output', 'Find the failure block most relevant to ', '.'), ('type_check', 'Find the failure block most relevant to ', '.'),
('coverage', 'Find the failure block most relevant to ', '.'), ('python', 'Find the runtime output block most relevant to ', '.'), ('curl', 'Find the API or docs block most relevant to how ', ' is described.'), ('pip_install', 'Find the dependency error block most relevant to ', '.'), ('helm', 'Find the evidence block most relevant to ', '.')) as t(kind, head, tail)""")
def extraction_query(spark, sf_dir):
    """What would be asked of each tool's output about an instance, an unknown tool among them."""
    i = table(spark, sf_dir, "instances").withColumn("focus", C.focus(F.col("patch"), F.col("problem_statement")))
    i = i.select("instance_id", "focus", F.explode(F.array(*(F.lit(t) for t in (*C.ASK, "helm")))).alias("tool_type"))
    return i.select("instance_id", "tool_type", "focus", C.extraction_query(F.col("tool_type"), F.col("focus")).alias("query"))


def _draw() -> str:
    upto, out = 0.0, "case when seq = 0 then 'read_file'"
    *most, last = C.WEIGHTS
    for kind in most:
        upto = round(upto + C.WEIGHTS[kind], 10)
        out += f" when u < {upto}::double then '{kind}'"
    return f"{out} else '{last}' end"


_DRAW = _draw()


@query("""with n as (select instance_id, 3 + ('0x' || left(md5('n|' || instance_id), 6))::bigint % 5 as n from instances), d as (select instance_id, unnest(range(0, n)) as seq from n),
u as (select instance_id, seq, ('0x' || left(md5('tool|' || instance_id || '|' || seq), 6))::bigint / 16777216.0::double as u from d)
select instance_id, seq::integer as seq, """ + _DRAW + """ as tool_type from u""")
def planned_calls(spark, sf_dir):
    """Three to seven tools an instance, the first reads a file, drawn by weight from a hash."""
    return C.plan(table(spark, sf_dir, "instances").select("instance_id"))
