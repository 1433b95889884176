"""Pieces of DuckDB SQL that several queries share."""

from ..functions.text import WS

LINES = "select sample_id, query, tool_type, unnest(string_split(tool_output, chr(10))) as line, generate_subscripts(string_split(tool_output, chr(10)), 1) as line_no from canonical_rows"

def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '{WS}+'), lambda w: w <> '')"



#: Merged spans of every row.
NORMAL = """
clamped as (select sample_id, greatest(1, sp.start_line) as a, least(n, sp.end_line) as b
  from (select sample_id, len(string_split(tool_output, chr(10))) as n, unnest(gold_spans) as sp from canonical_rows)),
before as (select *, max(b) over (partition by sample_id order by a, b rows between unbounded preceding and 1 preceding) as pb from clamped where a <= b),
grouped as (select *, sum(case when pb is null or a > pb + 1 then 1 else 0 end) over (partition by sample_id order by a, b rows unbounded preceding) as g from before),
normal as (select sample_id, cast(min(a) as integer) as start_line, cast(max(b) as integer) as end_line from grouped group by sample_id, g)"""

#: Lines kept by BM25.
BM25 = f"""
l as ({LINES}),
w as (select sample_id, line_no, line, {words("line")} as ws, list_sort(list_distinct({words("query")})) as terms from l),
n as (select *, count(*) over (partition by sample_id) as n, greatest(sum(len(ws)) over (partition by sample_id)::double / count(*) over (partition by sample_id), 1.0) as avg_len from w),
t as (select sample_id, line_no, len(ws) as dl, n, avg_len, u.term, u.j, list_count(list_filter(ws, lambda x: x = u.term))::double as tf
  from n, lateral (select unnest(terms) as term, generate_subscripts(terms, 1) as j) u),
d as (select *, sum(case when tf > 0 then 1 else 0 end) over (partition by sample_id, term)::double as df from t),
s as (select sample_id, line_no, list_sum(list(ln((n - df + 0.5::double) / (df + 0.5::double) + 1.0::double) * (tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avg_len))) order by j)) as score from d group by sample_id, line_no),
r as (select n.sample_id, n.line_no, n.line, n.n, row_number() over (partition by n.sample_id order by round(coalesce(s.score, 0), 9) desc, n.line_no desc) as rk from n left join s using (sample_id, line_no)),
kept as (select sample_id, cast(line_no as integer) as line_no, line from r where rk <= greatest(1, cast(floor(n * 0.1::double) as integer)))"""

STATS = "count({0}) as n, round(avg({0}), 4) as mean, round(median({0}), 4) as median, round(coalesce(stddev_samp({0}), 0), 4) as stdev, round(min({0}), 4) as lowest, round(max({0}), 4) as highest"
