"""Queries that check, gate, convert and review rows, and known answers on made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import WS
from ..operators import audit as A
from ..operators import calls as C
from ..operators import dataset as D
from ..operators import gates as G
from ..operators import metrics as M
from ..operators import patches as P
from ..operators import spans as S
from ..runtime import ranked, table
from . import evaluation, sql
from .assembly import _AUDIT, _REL
from .labels import _PATCH
from .registry import query


@query("""select * from (values (1, 'a' || chr(10) || 'b'), (2, ''), (3, ''), (4, '{"relevant_lines": "text"}'), (5, '[1, 2]'), (6, '1' || chr(10) || 'x'), (7, 'a' || chr(10) || 'b'), (8, 'one' || chr(10) || 'two'), (9, '{broken')) as t(id, parsed)""")
def reply_cases(spark, sf_dir):
    """Replies in every form a model may give."""
    rows = [
        (1, '{"relevant_lines": ["  a ", "", "b"]}'), (2, '{"relevant_lines": []}'), (3, '{"other": 1}'), (4, '{"relevant_lines": "text"}'), (5, "[1, 2]"), (6, ' {"relevant_lines": [1, " ", "x"]} '),
        (7, "Sure.\n<relevant_lines>\n  a\n\n b \n</relevant_lines>\nDone."), (8, "one\n \n two "), (9, "{broken"),
    ]
    return spark.createDataFrame(rows, "id int, reply string").select("id", F.array_join(D.parse_lines(F.col("reply")), "\n").alias("parsed"))


@query("select * from (values (1, '1,2'), (2, '4'), (3, '5,6'), (4, '7,8,9'), (5, null), (6, null), (7, ''), (8, '1'), (9, '3')) as t(id, numbers)")
def line_number_replies(spark, sf_dir):
    """Line numbers in replies: three keys, a bare list, a list among words, none."""
    rows = [(1, '{"lines": [1, 2.7, "3"]}'), (2, '{"line_numbers": [4]}'), (3, "[5, 6]"), (4, "see [7, 8,\n9] please"), (5, "none"), (6, '{"lines": "x"}'), (7, "[]"), (8, 'both {"x": [1]} and [2]'), (9, '{"lines": 7, "relevant_lines": [3, null]}')]
    return spark.createDataFrame(rows, "id int, reply string").select("id", F.array_join(X.line_numbers(F.col("reply")), ",").alias("numbers"))


@query("""select * from (values (1, 'https://a.example/x', 'https://api.github.com/repos/o/r/issues/12'), (2, 'https://b.example/y?q=1', 'https://api.github.com/repos/o/r/issues?per_page=5&state=all'), (3, 'http://c.example', 'https://api.github.com/repos/o/r/issues?per_page=5&state=all')) as t(id, links, issue)""")
def url_cases(spark, sf_dir):
    """Links in backticks, quotes and brackets; ids with and without a number at the end."""
    rows = [(1, "see `https://a.example/x` now", "o__r-12"), (2, '"https://b.example/y?q=1".', "o__r-12a"), (3, "(http://c.example);", "plain")]
    df = spark.createDataFrame(rows, "id int, text string, instance_id string")
    return df.select("id", F.array_join(X.urls(F.col("text")), ",").alias("links"), X.issue_url(F.col("instance_id"), F.lit("o/r")).alias("issue"))


@query("""select * from (values (1, 'gold_spans_not_normalized', 3, 0), (2, '', 2, 0), (3, 'duplicate_relevant_lines', 2, 1), (4, 'task_too_short,tool_output_too_short,high_relevant_ratio', 1, 0), (5, 'gold_spans_not_normalized', 0, 0)) as t(id, issues, n_lines, n_duplicates)""")
def audit_cases(spark, sf_dir):
    """Overlapping, fine, repeating, short and empty rows."""
    text, again = "\n".join(f"line number {i}" for i in range(1, 9)), "\n".join(["same line"] * 2 + [f"other {i}" for i in range(9)])
    rows = [(1, "what is wrong", text, [(1, 2), (2, 3)]), (2, "what is wrong", text, [(2, 3)]), (3, "what is wrong", again, [(1, 2)]), (4, "what", "short", [(1, 1)]), (5, "what is wrong", text, [(9, 12), (3, 1)])]
    df = spark.createDataFrame(rows, f"sample_id int, query string, tool_output string, gold_spans {S.SPANS}").withColumn("tool_type", F.lit("grep"))
    got = A.audit(df)
    return got.select(F.col("sample_id").alias("id"), F.array_join("issues", ",").alias("issues"), F.col("n_relevant_lines").cast("int").alias("n_lines"), F.col("duplicate_count").cast("int").alias("n_duplicates"))


@query("""select * from (values (1, ''), (2, 'relevant_lines_out_of_order'), (3, 'relevant_lines_missing'), (4, ''), (5, 'duplicate_relevant_lines'), (6, 'relevant_lines_out_of_order')) as t(id, issues)""")
def line_check_cases(spark, sf_dir):
    """Chosen lines that are in order, out of order, missing, changed in white space only, repeated, and out of order after one that is missing as it stands."""
    text = "\n".join(f"item {i} of  the list" for i in range(1, 10))
    pick = lambda *k: [f"item {i} of  the list" for i in k]
    rows = [(1, [*pick(1, 3), " "]), (2, pick(3, 1)), (3, ["item 77", *pick(2, 1)]), (4, ["item 2 of the list"]), (5, ["item 4", "item 4"]), (6, [*pick(4), "item 5 of the list", *pick(1)])]
    df = spark.createDataFrame(rows, "id int, lines array<string>")
    text = F.when(F.col("id") == 5, F.lit(text + "\nitem 4")).otherwise(F.lit(text))
    return df.select("id", F.array_join(A.check_lines(F.lit("a long query"), text, F.col("lines"))["issues"], ",").alias("issues"))


@query("""select * from (values (1, 'test'), (2, 'test'), (3, 'dev'), (4, 'dev'), (5, 'train'), (6, 'test')) as t(sample_id, split_name)""")
def split_cases(spark, sf_dir):
    """A group of two tool types has a split in each; a negative follows the type that came last; an unknown group is train."""
    rows = [(1, "synthetic", "a", "g1"), (2, "synthetic", "b", "g2"), (3, "synthetic", "c", "g4"), (4, "synthetic", "b", "g1"), (5, "synthetic_negative", "a", "gone"), (6, "synthetic_negative", "c", "g5"), (7, "synthetic", "c", "g3"), (8, "synthetic", "c", "g5")]
    got = D.made_splits(spark.createDataFrame(rows, "sample_id int, source string, tool_type string, group_id string"))
    return got.where("sample_id < 7")


_TEXT = """'<|im_start|>system' || chr(10) || 'You prune verbose tool output for a coding agent. Given a focused extraction query and one tool output, return only the smallest verbatim evidence block(s) the agent should read next. Return the kept text inside <relevant_lines> tags. Do not rewrite, summarize, or invent lines.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)"""
_USER = """'<query>' || chr(10) || (case when length(query) > 1000 then left(query, 1000) || '...' else query end) || chr(10) || '</query>' || chr(10)
 || (case when coalesce(background_task, '') <> '' then '<background_task>' || chr(10) || (case when length(background_task) > 3000 then left(background_task, 3000) || '...' else background_task end) || chr(10) || '</background_task>' || chr(10) else '' end) || '<tool_output>' || chr(10) || tool_output || chr(10) || '</tool_output>'"""
_REPLY = "'<relevant_lines>' || chr(10) || (case when n_rel > 0 then body || chr(10) else '' end) || '</relevant_lines>'"


@query(f"with {_REL} select sample_id, md5({_TEXT} || {_USER} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || {_REPLY} || '<|im_end|>') as text, md5({_USER}) as user_body from canonical_rows left join rel using (sample_id) where query <> '' and tool_output <> ''")
def training_text(spark, sf_dir):
    """Prompt, response and end mark as one text, and the user part cut out of the prompt."""
    rows = D.sft(D.canonical(table(spark, sf_dir, "canonical_rows")))
    return rows.select("sample_id", F.md5(D.training_text(F.col("prompt"), F.col("response"))).alias("text"), F.md5(D.user_body(F.col("prompt"))).alias("user_body"))


@query(f"""with {_REL}, l as (select sample_id, string_split(regexp_replace(coalesce(body, ''), '^{WS}+|{WS}+$', '', 'g'), chr(10)) as ls from canonical_rows left join rel using (sample_id))
select sample_id, regexp_replace(case when length(query) > 1000 then left(query, 1000) || '...' else query end, '^{WS}+|{WS}+$', '', 'g') as task, md5(regexp_replace(tool_output, '^{WS}+|{WS}+$', '', 'g')) as tool_output,
coalesce(list_aggregate(list_filter(ls, lambda x: not regexp_full_match(x, '{WS}*') and not regexp_matches(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g'), '^\\.\\.\\.\\s*\\(\\d+\\s+lines?\\s+omitted\\)$')), 'string_agg', chr(10)), '') as relevant, tool_type
from canonical_rows join l using (sample_id) where query <> '' and not regexp_full_match(tool_output, '{WS}*') and not contains(tool_output, '</tool_output>')""")
def encoder_convert(spark, sf_dir):
    """Chat rows converted to encoder rows: stripped sections, lines without blanks and omission notes."""
    rows = table(spark, sf_dir, "canonical_rows").where(~F.col("tool_output").contains("</tool_output>"))
    got = D.convert(D.sft(D.canonical(rows)).select("sample_id", "prompt", "response", "tool_type"))
    return got.select("sample_id", "task", F.md5("tool_output").alias("tool_output"), F.array_join("relevant_lines", "\n").alias("relevant"), "tool_type")


@query("select sample_id, case regexp_extract(instance_id, '(?s)^(.*)-[^-]*$', 1) when 'pydata__xarray' then 'test' when 'pallets__flask' then 'test' when 'psf__requests' then 'dev' else 'train' end as split_name from canonical_rows where source = 'swe' union all select * from (values (-1, 'test'), (-2, 'test'), (-3, 'dev'), (-4, 'train'))")
def repo_split(spark, sf_dir):
    """Real rows by sets of repositories, and four ids of known splits."""
    rows = table(spark, sf_dir, "canonical_rows").where("source = 'swe'").select("sample_id", "instance_id")
    more = spark.createDataFrame([(-1, "pydata__xarray-1234"), (-2, "pallets__flask-99"), (-3, "psf__requests-7"), (-4, "django__django-11099")], "sample_id long, instance_id string")
    return rows.unionByName(more).select("sample_id", D.repo_split(F.col("instance_id")).alias("split_name"))


_SEED = f"""seed as (select tool_type, p, e.task as task, e.tool_output as text, e.relevant_lines as ls from (select tool_type, unnest(seed_examples) as e, generate_subscripts(seed_examples, 1) as p from tool_configs)),
ln as (select tool_type, p, text, unnest(ls) as x, generate_subscripts(ls, 1) as i from seed),
ck as (select *, regexp_full_match(x, '{WS}*') as blank, contains(text, x) as there, contains(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g'), regexp_replace(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')) as near from ln),
walk as (select tool_type, p, 0::bigint as i, 1::bigint as at, true as ok from seed union all select c.tool_type, c.p, c.i, case when c.blank or instr(substr(c.text, w.at), c.x) = 0 then w.at else w.at + instr(substr(c.text, w.at), c.x) - 1 + length(c.x) end, w.ok and (c.blank or instr(substr(c.text, w.at), c.x) > 0 or not c.there) from walk w join ck c on c.tool_type = w.tool_type and c.p = w.p and c.i = w.i + 1),
ord as (select tool_type, p, bool_and(ok) as ok from walk group by tool_type, p),
agg as (select tool_type, p, count(*) as n, count(*) - count(distinct x) as dup, count(*) filter (where not blank and not there and not near) as missing from ck group by tool_type, p)"""


@query(f"""with recursive {_SEED} select s.tool_type, s.p::integer as place, coalesce(n, 0)::bigint as n_lines, coalesce(dup, 0)::bigint as duplicates, coalesce(missing, 0)::integer as missing, ok as in_order from seed s join ord using (tool_type, p) left join agg using (tool_type, p)""")
def seed_audit(spark, sf_dir):
    """Lines of the configured examples: how many, repeated, not in the output, and whether those there are in order."""
    e = table(spark, sf_dir, "tool_configs").select("tool_type", F.posexplode("seed_examples").alias("i", "e")).withColumns({"text": F.col("e.tool_output"), "lines": F.coalesce("e.relevant_lines", F.array().cast("array<string>"))})
    return e.select("tool_type", (F.col("i") + 1).alias("place"), F.size("lines").cast("long").alias("n_lines"), A.duplicates(F.col("lines")).alias("duplicates"), F.size(A.missing_lines(F.col("text"), F.col("lines"))).alias("missing"), A.in_order(F.col("text"), F.col("lines")).alias("in_order"))


@query("""select * from (values (1, '', true, true, 2), (2, 'invalid_response_json', false, false, 9), (3, 'relevant_lines_not_list', false, false, 9), (4, 'relevant_lines_not_all_strings', false, false, 9), (5, 'relevant_line_missing_from_prompt', false, false, 9), (6, 'relevant_lines_out_of_order', true, false, 9), (7, '', true, true, 0)) as t(id, issues, present, in_place, corrected)""")
def chat_audit_cases(spark, sf_dir):
    prompt = "<|im_start|>system\nline zero<|im_end|>\n<|im_start|>user\nline one\nline two<|im_end|>\n<|im_start|>assistant\n"
    replies = ['{"relevant_lines": ["line one", "line two"]}', "no json", '{"relevant_lines": "line one"}', '{"relevant_lines": ["line one", 3]}', '{"relevant_lines": ["line zero"]}', '{"relevant_lines": ["line two", "line one"]}', '{"relevant_lines": []}']
    df = spark.createDataFrame([(i + 1, prompt, r, 9, 4) for i, r in enumerate(replies)], "id int, prompt string, response string, num_relevant_lines int, num_total_lines int")
    return A.audit_chat(df).select("id", F.array_join("issues", ",").alias("issues"), "present", "in_place", F.col("corrected_num").cast("int").alias("corrected"))


@query(f"with {_REL} select count(*) as total_samples, count(*) as passing, 0::bigint as failing, 0::bigint as corrected, count(*) filter (where coalesce(n_rel, 0) > coalesce(n_distinct, 0)) as with_duplicates, false as all_totals_zero from canonical_rows left join rel using (sample_id) where query <> '' and tool_output <> ''")
def chat_audit_report(spark, sf_dir):
    """Chat rows with JSON responses, audited: their lines all stand in the prompt, in order."""
    rows = D.canonical(table(spark, sf_dir, "canonical_rows"))
    lines = S.extract(F.col("tool_output"), F.col("gold_spans"))
    chat = D.sft(rows).drop("response").join(rows.select("sample_id", F.to_json(F.struct(lines.alias("relevant_lines"))).alias("response")), "sample_id")
    return A.chat_report(A.audit_chat(chat))


@query(f"""with {sql.NORMAL}, l as ({sql.LINES}), f as (select sample_id, count(*) filter (where not regexp_full_match(line, '{WS}*')) as n_filled from l group by sample_id),
k as (select l.sample_id, count(*) as n from l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line where not regexp_full_match(line, '{WS}*') group by l.sample_id)
select c.sample_id, k.n::integer as n_numbers, n_filled::integer as n_filled from canonical_rows c join f using (sample_id) join k using (sample_id) where source = 'synthetic' and length(query) >= 10 and n_filled >= 5 and k.n / n_filled <= 0.6""")
def generated_gate(spark, sf_dir):
    """Made rows whose query, output and valid relevant lines pass."""
    rows = table(spark, sf_dir, "canonical_rows").where("source = 'synthetic'")
    numbers = F.flatten(F.transform(S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output"))), lambda s: F.sequence(s["start_line"], s["end_line"])))
    return G.generated(rows, numbers).select("sample_id", F.size("numbers").alias("n_numbers"), "n_filled")


@query(f"""with {_REL}, {sql.NORMAL.replace('clamped as', 'c2 as').replace('from clamped', 'from c2').replace('before as', 'b2 as').replace('from before', 'from b2').replace('grouped as', 'g2 as').replace('from grouped', 'from g2').replace('normal as', 'n2 as')},
gap as (select sample_id, start_line - coalesce(lag(end_line) over (partition by sample_id order by start_line), 0) > 1 as before, lead(start_line) over (partition by sample_id order by start_line) is null as last, end_line, start_line from n2),
sz as (select g.sample_id, sum(end_line - start_line + 1 + before::integer + (last and end_line < len(string_split(tool_output, chr(10))))::integer)::integer as d, bool_and(end_line - start_line = 0) as single from gap g join canonical_rows using (sample_id) group by g.sample_id),
raw as (select sample_id, sum(sp.end_line - sp.start_line + 1)::bigint as kept from (select sample_id, unnest(gold_spans) as sp from canonical_rows) group by sample_id)
select c.sample_id, d as distilled_lines, round(1 - d / len(string_split(tool_output, chr(10))), 4) as compression_ratio, kept as kept_lines from canonical_rows c join sz using (sample_id) join rel using (sample_id) left join raw using (sample_id)
where d <= len(string_split(tool_output, chr(10))) and not (regexp_full_match(body, '{WS}*') and d = n_rel)""")
def distilled_gate(spark, sf_dir):
    """Rows whose spans, with omission notes, leave text that is not longer than the output."""
    return G.distilled(table(spark, sf_dir, "canonical_rows")).select("sample_id", "distilled_lines", "compression_ratio", "kept_lines")


@query("select sample_id from canonical_rows where len(gold_spans) > 0 or source = 'synthetic_negative'")
def evidence_gate(spark, sf_dir):
    return G.with_evidence(table(spark, sf_dir, "canonical_rows")).select("sample_id")


@query("select t as tool_type from (values ('grep'), ('no_such_tool'), ('kubectl')) as w(t) where t not in (select tool_type from tool_configs)")
def unknown_tools(spark, sf_dir):
    return G.unknown_tools(table(spark, sf_dir, "tool_configs"), ["grep", "no_such_tool", "kubectl", "grep"])


_EX11 = f"{evaluation._EX}, e as (select *, case when contains(pred_text, 'Traceback') then 'traceback' end as error from (select *, coalesce(list_aggregate(pred, 'string_agg', chr(10)), '') as pred_text from m))"


def _reviewed(spark, sf_dir):
    """Examples with the measures that SQL can say; predictions that hold a traceback stand for errors."""
    m = M.span_metrics(F.col("pred"), F.col("ref"))
    ex = evaluation.examples(spark, sf_dir)
    text = F.array_join("pred", "\n")
    return ex.withColumns({"f1": m["f1"], "exact_match": m["exact_match"], "category": M.empty_category(F.col("pred"), F.col("ref")), "compression": M.compression(F.col("text"), text), "error": F.when(text.contains("Traceback"), "traceback")})


@query(f"""with {_EX11} select mode, count(*) as n, sum(sample_id)::bigint as ids from (select sample_id, unnest(list_filter(['all', case when error <> '' then 'errors' end, case when exact_match = 0 then 'bad_exact' end, case when category = 'false_negative' then 'false_negative' end, case when category = 'false_positive' then 'false_positive' end,
case when len(ref) = 0 then 'empty_gold' end, case when len(ref) > 0 then 'nonempty_gold' end], lambda x: x is not null)) as mode from e) group by mode""")
def review_modes(spark, sf_dir):
    """Every review filter but the fuzzy one: how many examples it shows, and the sum of their ids."""
    modes = {k: v for k, v in G.review_modes().items() if k != "bad_fuzzy"}
    rows = _reviewed(spark, sf_dir).select("sample_id", F.explode(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in modes.items())))).alias("mode"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.sum("sample_id").alias("ids"))


@query("with " + _EX11 + " " + " union all ".join(f"select '{k}' as mode, sample_id, row_number() over (order by {o}) as place from e" for k, o in (("original", "sample_id"), ("lowest_f1", "f1, sample_id"), ("highest_f1", "-f1, sample_id"), ("highest_compression", "-compression, sample_id"))))
def review_orders(spark, sf_dir):
    """Places of all examples in the review orders that need no measure of all pairs."""
    rows = _reviewed(spark, sf_dir).select("sample_id", "f1", "compression")
    out = None
    for mode in ("original", "lowest_f1", "highest_f1", "highest_compression"):
        got = ranked(rows, *G.review_order(mode, "sample_id"), name="k").select(F.lit(mode).alias("mode"), "sample_id", (F.col("k") + 1).alias("place"))
        out = got if out is None else out.unionByName(got)
    return out


@query()
def evaluation_bundle(spark, sf_dir):
    """All eleven measures: count, mean, median, deviation and range, without errored examples, which are counted."""
    return M.bundle(evaluation.examples(spark, sf_dir).withColumn("error", F.when(F.array_join("pred", "\n").contains("Traceback"), "traceback")), "sample_id")


@query(f"with {_AUDIT}, t as (select *, len(issues) > 0 as bad, row_number() over (partition by len(issues) > 0 order by md5('42|' || sample_id), sample_id) as rk from checks), n as (select least(count(*) filter (where not bad) // 10, 50) as most from t) select sample_id, case when bad then 'fail' else 'pass' end as status from t, n where bad or rk <= most")
def review_sample(spark, sf_dir):
    """All flagged rows and, by hashed order, a tenth of the passing ones, fifty at most."""
    a = A.audit(table(spark, sf_dir, "canonical_rows")).select("sample_id", "status")
    most = min(a.where("status = 'pass'").count() // 10, 50)
    passing = a.where("status = 'pass'").orderBy(D.order_key(42, F.col("sample_id")), "sample_id").limit(most)
    return a.where("status = 'fail'").unionByName(passing)


@query(f"with {_AUDIT}, q as (select tool_type, case when len(issues) > 0 then 5.0::double - len(issues) end as quality from checks) select tool_type, count(quality) as reviewed, round(coalesce(sum(quality), 0) / greatest(count(quality), 1), 4) as avg_quality from q group by tool_type")
def review_quality(spark, sf_dir):
    """Mean score of the reviewed (flagged) rows of each tool type, 0 without any; a score is five less the issues."""
    a = A.audit(table(spark, sf_dir, "canonical_rows")).select("tool_type", F.when(F.size("issues") > 0, F.lit(5.0) - F.size("issues")).alias("quality"))
    return a.groupBy("tool_type").agg(F.count("quality").alias("reviewed"), F.round(F.coalesce(F.sum("quality"), F.lit(0.0)) / F.greatest(F.count("quality"), F.lit(1)), 4).alias("avg_quality"))


@query("select source, bool_and(coalesce(is_irrelevant, false)) as all_irrelevant, bool_or(coalesce(is_irrelevant, false)) as any_irrelevant, bool_and(tool_output <> '') as all_filled, bool_or(length(tool_output) > 20000) as any_long from canonical_rows group by source")
def all_any(spark, sf_dir):
    bad = F.coalesce("is_irrelevant", F.lit(False))
    return table(spark, sf_dir, "canonical_rows").groupBy("source").agg(F.bool_and(bad).alias("all_irrelevant"), F.bool_or(bad).alias("any_irrelevant"), F.bool_and(F.col("tool_output") != "").alias("all_filled"), F.bool_or(F.length("tool_output") > 20000).alias("any_long"))


@query("select instance_id, count(*) as n_calls, string_agg(call_seq, ',' order by call_seq) as calls from tool_calls group by instance_id")
def calls_by_instance(spark, sf_dir):
    """Calls of each instance as one row, in order; an instance has few."""
    by = table(spark, sf_dir, "tool_calls").groupBy("instance_id").agg(F.count("*").alias("n_calls"), F.array_sort(F.collect_list("call_seq")).alias("c"))
    return by.select("instance_id", "n_calls", F.array_join("c", ",").alias("calls"))


_SIBLINGS = f"""{_PATCH}, avail as (select distinct instance_id, target_file as f from tool_calls where target_file is not null), sib as (select a.instance_id, a.f, regexp_replace(case when contains(a.f, '/') then a.f else './' || a.f end, '/[^/]*$', '') as dir from avail a where not exists (select 1 from files p where p.instance_id = a.instance_id and p.file = a.f)),
pfile as (select instance_id, file, i, regexp_replace(case when contains(file, '/') then file else './' || file end, '/[^/]*$', '') as dir, row_number() over (partition by instance_id order by i) as k from files)"""


@query(f"""with {_SIBLINGS}, near as (select s.*, s.dir in (select dir from pfile p where p.instance_id = s.instance_id) as related from sib s), pool as (select * from near n where related or not exists (select 1 from near m where m.instance_id = n.instance_id and m.related)),
d as (select instance_id, arg_min(f, md5('decoy|' || instance_id || '|' || f)) as decoy from pool group by instance_id), t as (select instance_id, arg_min(file, md5('patch|' || instance_id || '|' || file)) as target from pfile group by instance_id)
select i.instance_id, case when target is not null and (decoy is null or ('0x' || left(md5('read|' || i.instance_id), 6))::bigint / 16777216.0::double < 0.8) then target else decoy end as target, target is not null and (decoy is null or ('0x' || left(md5('read|' || i.instance_id), 6))::bigint / 16777216.0::double < 0.8) as is_patch_file
from instances i left join t using (instance_id) left join d using (instance_id) where target is not null or decoy is not null""")
def read_targets(spark, sf_dir):
    """The file to read for each instance: one of its patch in four of five cases, else a sibling, of the same folder if there is one."""
    calls = table(spark, sf_dir, "tool_calls").where("target_file is not null").select("instance_id", F.col("target_file").alias("file")).distinct()
    return C.read_targets(table(spark, sf_dir, "instances"), calls)


@query(f"""with {_SIBLINGS}, near as (select p.instance_id, s.f, p.k, row_number() over (partition by p.instance_id, p.k order by s.f) as r from pfile p join sib s using (instance_id, dir) where p.k <= 5), few as (select distinct instance_id, f from near where r <= 6),
top as (select *, row_number() over (partition by instance_id order by f) as n from few) select instance_id, f as file, 'sibling' as kind from top where n <= 15 union all select instance_id, file, 'patch' from pfile""")
def source_plan(spark, sf_dir):
    """Files to fetch: those of the patch, and siblings in their folders: six of each of the first five, fifteen in all."""
    calls = table(spark, sf_dir, "tool_calls").where("target_file is not null").select("instance_id", F.col("target_file").alias("file")).distinct()
    return C.source_plan(table(spark, sf_dir, "instances"), calls)


@query("select instance_id, repo, case lower(n) when 'scikit-learn' then 'sklearn' when 'scikit-image' then 'skimage' when 'pillow' then 'PIL' when 'pyyaml' then 'yaml' when 'python-dateutil' then 'dateutil' when 'beautifulsoup4' then 'bs4' else replace(n, '-', '_') end as module from (select *, case when contains(repo, '/') then string_split(repo, '/')[2] else repo end as n from (select instance_id, repo from instances union all select * from (values ('x', 'a/Scikit-Learn'), ('y', 'Pillow'), ('z', 'b/my-tool')) as v(instance_id, repo)))")
def import_names(spark, sf_dir):
    rows = table(spark, sf_dir, "instances").select("instance_id", "repo").unionByName(spark.createDataFrame([("x", "a/Scikit-Learn"), ("y", "Pillow"), ("z", "b/my-tool")], "instance_id string, repo string"))
    return rows.select("instance_id", "repo", X.import_name(F.col("repo")).alias("module"))


@query("""select call_seq, coalesce(nullif(search_term, ''), case tool_type when 'read_file' then 'Find the smallest code block most relevant to the task.' when 'git_diff' then 'Find the smallest diff hunk most relevant to the task.' when 'grep' then 'Find the grep hits most relevant to the task.'
when 'ls' then 'Find the file or directory entries most relevant to the task.' when 'git_log' then 'Find the commit entry most relevant to the task.' when 'git_blame' then 'Find the blame block most relevant to the task.' when 'python' then 'Find the runtime output block most relevant to the task.'
when 'curl' then 'Find the returned docs or API block most relevant to the task.' else case when tool_type in ('test_output', 'build_output', 'lint_output', 'type_check', 'pip_install') then 'Find the failure block most relevant to the task.' else 'Find the evidence block most relevant to the task.' end end) as query from tool_calls""")
def fallback_queries(spark, sf_dir):
    """What to ask of a call's output where no query was written: its search term, else by tool type."""
    return table(spark, sf_dir, "tool_calls").select("call_seq", C.fallback_query(F.col("tool_type"), F.col("search_term")).alias("query"))


@query(f"with {_AUDIT} select sample_id, tool_type, list_aggregate(issues, 'string_agg', ',') as issues from checks where len(issues) > 0")
def flagged_rows(spark, sf_dir):
    a = A.audit(table(spark, sf_dir, "canonical_rows"))
    return a.where("status = 'fail'").select("sample_id", "tool_type", F.array_join("issues", ",").alias("issues"))


@query(f"with l as ({sql.LINES}), w as (select sample_id, line_no, unnest({sql.words('line')}) as w from l) select sample_id, (line_no - 1)::bigint as segment, max(length(w))::double as best, round(avg(length(w)) + 1e-9, 4) as mean from w group by sample_id, line_no")
def segment_pool(spark, sf_dir):
    """Word lengths as scores of tokens, lines set apart by separators, pooled back to lines."""
    from ..operators import scoring

    sizes = F.flatten(F.transform(X.lines(F.col("tool_output")), lambda x, i: F.concat(F.when(i > 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), F.transform(X.words(x), F.length))))
    rows = table(spark, sf_dir, "canonical_rows").select(F.col("sample_id").alias("id"), sizes.alias("tokens"))
    got = scoring.pooled_segments(rows.withColumn("scores", F.transform("tokens", lambda t: t.cast("double"))), -1)
    return got.select(F.col("id").alias("sample_id"), "segment", "best", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query(f"""with {_REL}, k as (select sample_id, length({_TEXT} || {_USER} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) as size, round(1 - coalesce(n_rel, 0) / len(string_split(tool_output, chr(10))), 4) as ratio, split_name = 'test' as is_eval, tool_type from canonical_rows left join rel using (sample_id) where query <> '' and tool_output <> '' and split_name in ('train', 'test')),
a as (select count(*)::double as n, avg(ratio) as ratio, (count(*) filter (where is_eval))::double as n_eval, (count(*) filter (where size > 50000))::double as long, (select count(*) from (values ('read_file'), ('grep'), ('git_log'), ('test_output'), ('git_diff')) as t(x) where x not in (select tool_type from k))::double as missing from k)
select 'no_samples' as warning, n as value from a where n = 0 union all select 'mean_ratio_low', round(ratio, 4) from a where n > 0 and ratio < 0.5 union all select 'missing_tools', missing from a where n > 0 and missing > 0 union all select 'few_eval_samples', n_eval from a where n > 0 and n_eval < 10 union all select 'long_prompts', long from a where long > 0""")
def validation_warnings(spark, sf_dir):
    """What a validation of train and test warns of."""
    rows = D.canonical(table(spark, sf_dir, "canonical_rows")).where("split_name in ('train', 'test')")
    chat = D.sft(rows).join(rows.select("sample_id", (F.col("split_name") == "test").alias("is_eval")), "sample_id")
    return G.warnings(chat)


@query(r"""select call_seq, target_file, string_split(target_file, '/')[-1] as name, case when regexp_matches(string_split(target_file, '/')[-1], '.\.[^.]*$') then regexp_extract(string_split(target_file, '/')[-1], '^(.+)\.[^.]*$', 1) else string_split(target_file, '/')[-1] end as stem,
case when contains(target_file, '/') then regexp_replace(target_file, '/[^/]*$', '') else '.' end as folder, replace(regexp_replace(target_file, '\.py$', ''), '/', '.') as module from tool_calls where target_file is not null""")
def path_parts(spark, sf_dir):
    f = F.col("target_file")
    return table(spark, sf_dir, "tool_calls").where("target_file is not null").select("call_seq", "target_file", X.basename(f).alias("name"), X.stem(f).alias("stem"), X.parent(f).alias("folder"), X.module_of(f).alias("module"))


@query(f"""with w as (select distinct sample_id, tool_output, unnest({sql.words('query')}) as w from canonical_rows), p as (select *, instr(lower(tool_output), w) as pos from w where contains(lower(tool_output), w)),
n as (select distinct sample_id, len(string_split(left(tool_output, pos - 1), chr(10))) as line_no, tool_output from p) select sample_id, line_no::integer as line_no, md5(string_split(tool_output, chr(10))[line_no]) as line from n""")
def span_hook(spark, sf_dir):
    """Lines that the highlighter hook's spans touch."""
    from ..operators import scoring

    rows = table(spark, sf_dir, "canonical_rows").select(F.col("sample_id").alias("id"), F.col("tool_output").alias("text"), "query")
    return scoring.highlighted(rows).select(F.col("id").alias("sample_id"), "line_no", F.md5("line").alias("line"))


@query("with s as (select sample_id, [ln(length(tool_output) + 1.0::double), ln(length(query) + 1.0::double), len(gold_spans)::double] as x from canonical_rows), e as (select sample_id, list_transform(x, lambda v: exp(v - list_max(x))) as p from s) select sample_id, round(p[1] / list_sum(p), 6) as p_output, round(p[2] / list_sum(p), 6) as p_query, round(p[3] / list_sum(p), 6) as p_spans from e")
def softmax_shares(spark, sf_dir):
    from ..operators import scoring

    x = F.array(F.ln(F.length("tool_output") + F.lit(1.0)), F.ln(F.length("query") + F.lit(1.0)), F.size("gold_spans").cast("double"))
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", scoring.softmax(x).alias("p"))
    return rows.select("sample_id", *(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p_output", "p_query", "p_spans"))))
