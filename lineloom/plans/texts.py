"""Queries over texts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import WS
from ..operators import lines as L
from ..operators import rank, windows
from ..operators import spans as S
from ..runtime import table
from . import sql
from .registry import query


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text, query of every row."""
    return table(spark, sf_dir, "canonical_rows").select(F.col("sample_id").alias("id"), F.col("tool_output").alias("text"), "query")


def _kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    got = rank.PRUNERS[name](observations(spark, sf_dir))
    return got.select(F.col("id").alias("sample_id"), F.explode("kept").alias("line_no"))


@query("select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::integer as line_no from documents where text is not null")
def lines_explode(spark, sf_dir):
    return L.explode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query(f"with l as ({sql.LINES}) select sample_id, count(*) as n_lines, count(*) filter (where not regexp_full_match(line, '{WS}*')) as n_filled, max(length(line))::bigint as longest, round(avg(length(line)), 4) as mean_length from l group by sample_id")
def line_stats(spark, sf_dir):
    size = F.transform("lines", F.length)
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", X.lines(F.col("tool_output")).alias("lines"))
    mean = F.aggregate(size, F.lit(0).cast("long"), lambda a, x: a + x) / F.size("lines")
    return rows.select("sample_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: ~X.is_blank(x))).cast("long").alias("n_filled"), F.array_max(size).cast("long").alias("longest"), F.round(mean, 4).alias("mean_length"))


@query(f"with l as ({sql.LINES}), o as (select sample_id, line_no::integer as line_no, line, coalesce(sum(length(line) + 1) over (partition by sample_id order by line_no rows between unbounded preceding and 1 preceding), 0)::integer as start from l) select sample_id, line_no, line, start, (start + length(line))::integer as stop from o")
def line_offsets(spark, sf_dir):
    return L.offsets(table(spark, sf_dir, "canonical_rows"), "tool_output", ["sample_id"])


@query(f"""with l as ({sql.LINES}),
c as (select sample_id, query, line_no, line, sum(length(line) + 1) over (partition by sample_id order by line_no) - length(line) - 1 as lo from l),
s as (select *, instr(lower(tool_output), q) - 1 as a, length(q) as m from (select sample_id, tool_output, regexp_extract(lower(query), '([a-z0-9]+_[a-z0-9_]+)', 1) as q from canonical_rows) where q <> '' and instr(lower(tool_output), q) > 0)
select c.sample_id, c.line_no::integer as line_no, c.line from c join s using (sample_id) where not (s.a + s.m <= c.lo or s.a >= c.lo + length(c.line)) and not regexp_full_match(c.line, '{WS}*')""")
def char_span_overlap(spark, sf_dir):
    """Filled lines that the first occurrence of the query's name touches, a half-open span of characters."""
    rows = table(spark, sf_dir, "canonical_rows").withColumn("name", F.regexp_extract(F.lower("query"), "([a-z0-9]+_[a-z0-9_]+)", 1))
    rows = rows.withColumn("a", F.expr("instr(lower(tool_output), name) - 1")).where("name <> '' and a >= 0").withColumn("b", F.col("a") + F.length("name"))
    got = L.offsets(rows, "tool_output", ["sample_id", "a", "b"])
    return got.where(~((F.col("b") <= F.col("start")) | (F.col("a") >= F.col("stop"))) & ~X.is_blank(F.col("line"))).select("sample_id", "line_no", "line")


@query(f"""with l as ({sql.LINES}), n as (select *, count(*) over (partition by sample_id) as n from l),
p as (select sample_id, n, string_agg(line_no || ': ' || line, chr(10) order by line_no) as numbered, string_agg(line, chr(10) order by line_no) filter (where line_no <= 20) as head from n group by sample_id, n)
select sample_id, md5(numbered) as numbered, case when n > 20 then head || chr(10) || '... (' || (n - 20) || ' more lines omitted)' else head end as head from p""")
def number_truncate(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows")
    return rows.select("sample_id", F.md5(L.numbered(F.col("tool_output"))).alias("numbered"), L.truncated(F.col("tool_output"), 20).alias("head"))


@query(f"""with l as ({sql.LINES}), n as (select sample_id, line_no, count(*) over (partition by sample_id) as n, line_no || ': ' || (case when length(line) > 60 then left(line, 60) || ' ... [truncated for prompt]' else line end) as t from l qualify line_no <= 40),
c as (select *, sum(length(t) + 1) over (partition by sample_id order by line_no) as upto from n),
k as (select sample_id, n, count(*) filter (where upto <= 2000) as done, count(*) filter (where upto > 2000) > 0 as is_full, string_agg(t, chr(10) order by line_no) filter (where upto <= 2000) as body from c group by sample_id, n)
select sample_id, concat_ws(chr(10), body, case when is_full then (done + 1) || ': ... [prompt view truncated at 2000 chars]' end, case when n > done then (done + 1) || ': ... [' || (n - done) || ' lines omitted for prompt]' end) as view from k""")
def bounded_view(spark, sf_dir):
    return table(spark, sf_dir, "canonical_rows").select("sample_id", L.bounded_view(F.col("tool_output"), 40, 60, 2000).alias("view"))


@query(f"with {sql.BM25} select sample_id, line_no from kept")
def bm25_top_lines(spark, sf_dir):
    return _kept(spark, sf_dir, "bm25")


_COUNTED = f"with l as ({sql.LINES}), n as (select sample_id, line_no::integer as line_no, count(*) over (partition by sample_id) as n from l), k as (select *, greatest(1, floor(n * 0.1::double)::integer) as k from n) "


@query(_COUNTED + "select sample_id, line_no from k where line_no <= k")
def first_n(spark, sf_dir):
    return _kept(spark, sf_dir, "first")


@query(_COUNTED + "select sample_id, line_no from k where line_no > n - k")
def last_n(spark, sf_dir):
    return _kept(spark, sf_dir, "last")


@query(_COUNTED + ", r as (select *, row_number() over (partition by sample_id order by md5('42|' || sample_id || '|' || line_no)) as r from k) select sample_id, line_no from r where r <= k")
def hash_n(spark, sf_dir):
    return _kept(spark, sf_dir, "hash")


@query(f"with {sql.BM25}, i as (select sample_id, line_no, line_no - row_number() over (partition by sample_id order by line_no) as g from kept) select sample_id, min(line_no)::integer as start_line, max(line_no)::integer as end_line from i group by sample_id, g")
def keyword_islands(spark, sf_dir):
    """Top tenth of the lines by BM25 as runs of consecutive lines."""
    got = rank.bm25(observations(spark, sf_dir))
    return got.select(F.col("id").alias("sample_id"), F.inline(rank.islands(F.col("kept"))))


@query(f"with {sql.NORMAL} select * from normal")
def span_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows")
    return rows.select("sample_id", F.inline(S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output")))))


@query("select sample_id, coalesce(list_sum(list_transform(gold_spans, lambda s: s.end_line - s.start_line + 1)), 0)::bigint as kept_lines from canonical_rows")
def span_raw_length(spark, sf_dir):
    return table(spark, sf_dir, "canonical_rows").select("sample_id", S.covered_lines(F.col("gold_spans")).alias("kept_lines"))


@query(f"with {sql.NORMAL}, l as ({sql.LINES}) select l.sample_id, string_agg(line, chr(10) order by line_no) as relevant from l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line group by l.sample_id")
def span_extract_text(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", "tool_output", S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output"))).alias("spans"))
    return rows.where("size(spans) > 0").select("sample_id", F.array_join(S.extract(F.col("tool_output"), F.col("spans")), "\n").alias("relevant"))


@query(f"""with {sql.NORMAL}, l as ({sql.LINES}),
total as (select sample_id, max(line_no) as n from l group by sample_id),
gaps as (select sample_id, start_line, end_line, coalesce(lag(end_line) over (partition by sample_id order by start_line), 0) as prev, lead(start_line) over (partition by sample_id order by start_line) as nxt from normal),
parts as (select sample_id, start_line - 0.5 as pos, '... (' || (start_line - prev - 1) || ' lines omitted)' as line from gaps where start_line - prev > 1
  union all select g.sample_id, end_line + 0.5, '... (' || (n - end_line) || ' lines omitted)' from gaps g join total using (sample_id) where nxt is null and n > end_line
  union all select l.sample_id, line_no, line from l join normal m on l.sample_id = m.sample_id and l.line_no between m.start_line and m.end_line)
select c.sample_id, coalesce(t.filtered, '') as filtered from canonical_rows c left join (select sample_id, string_agg(line, chr(10) order by pos) as filtered from parts group by sample_id) t using (sample_id)""")
def omission_markers(spark, sf_dir):
    rows = table(spark, sf_dir, "canonical_rows")
    return rows.select("sample_id", L.kept_text(F.col("tool_output"), S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output")))).alias("filtered"))


@query(f"select doc_id, regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g') as squashed from documents where text is not null")
def whitespace_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.squash(F.col("text")).alias("squashed"))


def _squash_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')"


@query(f"""with {sql.NORMAL}, l as (select sample_id, line_no, {_squash_sql('line')} as t from ({sql.LINES})),
refs as (select l.sample_id, list(distinct t) as refs from l join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line where t <> '' group by l.sample_id)
select l.sample_id, l.line_no::integer as line_no from l join refs r using (sample_id) where t <> '' and len(list_filter(r.refs, lambda x: x = l.t or contains(x, l.t) or contains(l.t, x))) > 0""")
def line_match(spark, sf_dir):
    """Lines that equal, hold or stand in one of the row's relevant lines, white space normalised."""
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", "tool_output", S.normalise(F.col("gold_spans"), S.n_lines(F.col("tool_output"))).alias("spans")).where("size(spans) > 0")
    return rows.select("sample_id", F.explode(rank.matched(F.col("tool_output"), S.extract(F.col("tool_output"), F.col("spans")))).alias("line_no"))


@query(f"""with recursive l as (select sample_id, line_no, len({sql.words('line')}) as n from ({sql.LINES})), c as (select sample_id, line_no, n, unnest(range(0, ((n + 59) // 60)::bigint)) as part from l where n > 0),
it as (select sample_id, row_number() over (partition by sample_id order by line_no, part) - 1 as i, least(60, n - part * 60) as size from c), ps as (select *, sum(size + 1) over (partition by sample_id order by i) as s, count(*) over (partition by sample_id) as total from it),
reach as (select a.sample_id, a.i as head, a.total, greatest(a.i + 1, max(b.i) + 1) as stop from ps a join ps b on a.sample_id = b.sample_id and b.i between a.i and a.i + 120 and b.s - (a.s - a.size - 1) - 1 <= 120 group by a.sample_id, a.i, a.total),
w as (select sample_id, head, stop, total from reach where head = 0 union all select r.sample_id, r.head, r.stop, r.total from w join reach r on r.sample_id = w.sample_id and r.head = greatest(w.head + 1, w.stop - 2))
select sample_id, head::integer as first, stop::integer as stop from w""")
def token_windows(spark, sf_dir):
    """Windows of at most 120 words over the filled lines, two lines of overlap."""
    sizes = F.transform(X.lines(F.col("tool_output")), lambda x: F.size(X.words(x)))
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", F.transform(windows.chunks(sizes, 60), lambda c: c["size"]).alias("sizes"))
    return rows.select("sample_id", F.inline(windows.greedy(F.col("sizes"), 120)))


@query(f"""with l as ({sql.LINES}), s as (select sample_id, line_no, len({sql.words('line')}) as n from l),
c as (select sample_id, line_no, n, unnest(range(0, ((n + 7) // 8)::bigint)) as part from s where n > 0)
select sample_id, line_no::integer as line_no, least(8, n - part * 8)::integer as size, (part + 1)::integer as part from c""")
def line_chunks(spark, sf_dir):
    """Filled lines as chunks of at most eight words."""
    sizes = F.transform(X.lines(F.col("tool_output")), lambda x: F.size(X.words(x)))
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", F.posexplode(sizes).alias("i", "n")).where("n > 0")
    return rows.select("sample_id", (F.col("i") + 1).alias("line_no"), "n", F.posexplode(windows.chunks(F.array("n"), 8)).alias("p", "c")).select("sample_id", "line_no", F.col("c.size").alias("size"), (F.col("p") + 1).alias("part"))


@query(f"""with l as ({sql.LINES}), t as (select sample_id, line_no, len(list_intersect({sql.words('line')}, {sql.words('query')}))::double as hits from l),
w as (select sample_id, line_no, unnest([((line_no - 1) // 10), ((line_no - 1) // 10) - 1]) as win, hits from t),
m as (select sample_id, win, max(hits) as best from w where win >= 0 group by sample_id, win),
j as (select w.sample_id, w.line_no, max(w.hits / (1 + m.best)) as score from w join m using (sample_id, win) where w.win >= 0 group by w.sample_id, w.line_no)
select sample_id, line_no::integer as line_no, round(greatest(score, 0.0), 6) as score from j where score >= 0.5""")
def window_max_score(spark, sf_dir):
    """Best score of a line over the windows of ten steps and twenty lines that hold it, from 0.5 on: words of the query
    in the line against those in the window's best line."""
    hits = F.transform(X.lines(F.lower("tool_output")), lambda x: F.size(F.array_intersect(X.words(x), X.words(F.lower("query")))).cast("double"))
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", hits.alias("hits"))
    best = F.transform(F.sequence(F.lit(0), F.floor((F.size("hits") - 1) / 10).cast("int")), lambda w: F.array_max(F.slice("hits", w * 10 + 1, 20)))
    rows = rows.withColumn("best", best).select("sample_id", "best", F.posexplode("hits").alias("i", "h")).where("h > 0")
    win = F.floor(F.col("i") / 10).cast("int")
    score = F.greatest(F.col("h") / (1 + F.get("best", win)), F.coalesce(F.col("h") / (1 + F.get("best", win - 1)), F.lit(0.0)))
    return rows.select("sample_id", (F.col("i") + 1).alias("line_no"), F.round(score, 6).alias("score")).where("score >= 0.5")


@query("select doc_id, regexp_extract(text, '([a-z]+(?:_[a-z0-9]+)+)', 1) as name, len(string_split(text, '/'))::bigint - 1 as slashes, floor(length(text) / 4)::bigint as tokens, length(text) = n_chars as counted from documents where text is not null")
def document_facts(spark, sf_dir):
    """Name, estimated tokens and whether n_chars counts code points."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.regexp_extract("text", "([a-z]+(?:_[a-z0-9]+)+)", 1).alias("name"), (F.size(F.split("text", "/", -1)) - 1).cast("long").alias("slashes"), X.tokens_of(F.col("text")).alias("tokens"), (F.length("text") == F.col("n_chars")).alias("counted"))


@query(r"""select doc_id, u as url, regexp_extract(u, '^https?://([^/:]+)', 1) as host from (select doc_id, unnest(list_transform(regexp_extract_all(text, 'https?://[^\s"`''<>]+'), lambda x: regexp_replace(x, '[.,;)]+$', ''))) as u from documents where text is not null)""")
def document_urls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(X.urls(F.col("text"))).alias("url"))
    return d.withColumn("host", F.regexp_extract("url", "^https?://([^/:]+)", 1))


@query(f"with l as ({sql.LINES}), w as (select sample_id, line_no, list_distinct({sql.words('query')}) as q, list_distinct({sql.words('line')}) as ws from l) select sample_id, line_no::integer as line_no, len(list_intersect(q, ws)) / greatest(len(q), 1) as score from w where len(list_intersect(q, ws)) / greatest(len(q), 1) >= 0.5")
def scored_lines(spark, sf_dir):
    """Lines that hold half of the query's words, by the scorer hook."""
    from ..operators import scoring

    return scoring.over_threshold(scoring.line_scores(observations(spark, sf_dir))).withColumnRenamed("id", "sample_id")


@query(f"""with {sql.NORMAL}, l as ({sql.LINES}), w as (select l.sample_id, (l.line_no - 1) // 20 as win, max((n.sample_id is not null)::integer) = 1 as positive from l left join normal n on l.sample_id = n.sample_id and l.line_no between n.start_line and n.end_line group by l.sample_id, win),
k as (select *, sample_id || '|' || win as key from w), r as (select *, row_number() over (partition by positive order by md5('42|' || key), key) as rk, (select count(*) from k where positive) as n from k)
select sample_id, win::integer as win, positive from r where positive or rk <= floor(n * 0.3::double / (1 - 0.3::double))""")
def window_sample(spark, sf_dir):
    """Windows of twenty lines: all with a relevant line, and others up to three tenths."""
    from ..operators import scoring

    n = S.n_lines(F.col("tool_output"))
    rows = table(spark, sf_dir, "canonical_rows").select("sample_id", n.alias("n"), S.normalise(F.col("gold_spans"), n).alias("spans"))
    rows = rows.select("sample_id", "spans", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 20).cast("int"))).alias("win"))
    hit = F.exists("spans", lambda s: (s["start_line"] <= (F.col("win") + 1) * 20) & (s["end_line"] > F.col("win") * 20))
    rows = rows.select("sample_id", "win", hit.alias("positive"), F.concat_ws("|", "sample_id", "win").alias("key"))
    return scoring.balanced(rows, 0.3).drop("key")
