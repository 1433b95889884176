"""The pN_ queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..runtime import checkpoint_dir, stable, table
from . import leak, mixing, near_dup, overlap, pieces, spam, splits, tokenise, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = truncation.cut_rows(table(spark, sf_dir, "canonical_rows"))
    return found.where("log_odds > 0").select(F.col("id").alias("sample_id"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: rows, rows cut off, their share, and the limits that were met."""
    found, limits = truncation.cut_rows(table(spark, sf_dir, "canonical_rows"))
    at = spark.createDataFrame([(s, n) for s, n, _, p in limits if p > 0.5] or [("", 0)], "source string, n int").groupBy("source").agg(F.array_sort(F.collect_set("n")).alias("limits"))
    by = found.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("log_odds") > 0).alias("cut"), F.avg((F.col("log_odds") > 0).cast("int")).alias("share"))
    return by.join(at, "source", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_pairs(table(spark, sf_dir, "canonical_rows"))


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assigned rows and quarantined components; the component table is kept in the folder that ``spark.lineloom.splits`` names."""
    rows = table(spark, sf_dir, "canonical_rows")
    targets = [(r.split_name, r.target_share) for r in table(spark, sf_dir, "split_targets").collect()]
    keys = splits.record_keys(F.col("source"), F.col("instance_id"), F.col("output_origin_instance_id"))
    records = rows.select(F.col("sample_id").alias("id"), keys.alias("keys"), F.col("split_name").alias("was"))
    if path := spark.conf.get("spark.lineloom.splits", None):
        return splits.advance(records, targets, path)
    assigned, _, quarantined = splits.update(records, targets, conflicts=True)
    return assigned, quarantined


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's component and split; 'moved' rows had another split, 'new' components had none, 'quarantined' ones several."""
    assigned, _ = _splits(spark, sf_dir)
    return assigned.select(F.col("id").alias("sample_id"), "component", F.col("split").alias("split_name"), "status")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, components and share of every split against its target."""
    assigned, _ = _splits(spark, sf_dir)
    assigned = stable(assigned)
    n = max(assigned.count(), 1)
    by = assigned.groupBy(F.col("split").alias("split_name")).agg(F.count("*").alias("rows"), F.countDistinct("component").alias("components"), F.count_if(F.col("was") != F.col("split")).alias("moved"), F.count_if(F.col("status") == "quarantined").alias("quarantined"), (F.count("*") / F.lit(n)).alias("share"))
    return by.join(F.broadcast(table(spark, sf_dir, "split_targets")), "split_name", "full")


def p3_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined components: the splits that met in them, and their rows."""
    return _splits(spark, sf_dir)[1]


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows in two batches through a kept component table: all but the negatives, then the negatives."""
    rows = table(spark, sf_dir, "canonical_rows")
    targets = [(r.split_name, r.target_share) for r in table(spark, sf_dir, "split_targets").collect()]
    keys = splits.record_keys(F.col("source"), F.col("instance_id"), F.col("output_origin_instance_id"))
    records = rows.select(F.col("sample_id").alias("id"), keys.alias("keys"), F.col("split_name").alias("was"), F.when(F.col("source") == "synthetic_negative", 2).otherwise(1).alias("batch"))
    path = f"{checkpoint_dir(spark)}/splits-{uuid.uuid4()}"
    splits.advance(records.where("batch = 1").drop("batch"), targets, path)
    assigned, _ = splits.advance(records.drop("batch"), targets, path)
    return assigned.join(records.select("id", "batch"), "id").select(F.col("id").alias("sample_id"), "batch", F.col("split").alias("split_name"), "status")


def p4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a row in a mix: line, copy, output shard and place in it."""
    return mixing.mix(table(spark, sf_dir, "canonical_rows"), table(spark, sf_dir, "mix_targets"))


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row is used in each line of a mix."""
    used, lines = mixing.planned(table(spark, sf_dir, "canonical_rows"), table(spark, sf_dir, "mix_targets"))
    names = spark.createDataFrame([(x["line"], x["mix"], x["source"], x["tool"]) for x in lines], f"line int, {mixing.USES}")
    return used.where("copies > 0").join(F.broadcast(names), "line").select("mix_name", "source", "tool_type", F.col("id").alias("sample_id"), "copies")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(*mixing.planned(table(spark, sf_dir, "canonical_rows"), table(spark, sf_dir, "mix_targets")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(table(spark, sf_dir, "canonical_rows"), table(spark, sf_dir, "piece_limits"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's group of near-same outputs: the smallest id of its component, class id and number of linked classes.

    Rows with fewer than eight words, or null output, are groups of their own without links.
    """
    rows = table(spark, sf_dir, "canonical_rows")
    members, found = near_dup.links(rows, "sample_id", "tool_output")
    found = stable(found.select("a", "b"))
    root = splits.components(found, members.select(F.col("rep").alias("node")).distinct())
    degree = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    grouped = members.join(root.select(F.col("node").alias("rep"), "root"), "rep").join(degree, "rep", "left")
    return rows.select(F.col("sample_id").alias("id")).join(grouped, "id", "left").select(F.col("id").alias("sample_id"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("root", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "canonical_rows")
    members, pairs = overlap.near_texts(rows)
    found = overlap.same_queries(members, stable(pairs), rows)
    return found.select(F.least("eval_id", "train_id").alias("sample_id_a"), F.greatest("eval_id", "train_id").alias("sample_id_b"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-same texts of evaluation and training rows under any query: pairs of the smallest ids with their bags of words."""
    _, pairs = overlap.near_texts(table(spark, sf_dir, "canonical_rows"))
    return pairs.select("eval_id", "train_id", F.round("shared", 4).alias("shared"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "canonical_rows")
    members, pairs = overlap.near_texts(rows)
    pairs = stable(pairs)
    return overlap.report(members, pairs, stable(overlap.same_queries(members, pairs, rows)), rows)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise.token_ids(table(spark, sf_dir, "documents"))


def p7_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids, first code point of every slice and number of its ids, as decoding by place needs them."""
    return tokenise.token_ids(table(spark, sf_dir, "documents"), offsets=True)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked(_leaks(spark, sf_dir))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test item that shares a run: documents that hold it, those with less than half of it, its best coverage, and its longest tile."""
    share = F.col("tiled") / F.col("item_words")
    held = share >= leak.SHARE
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct(F.when(held, F.col("doc_id"))).alias("documents"), F.countDistinct(F.when(~held, F.col("doc_id"))).alias("partial"), F.round(F.max(share), 4).alias("best_cover"), F.max("longest").alias("longest_tile"))


def p8_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that share a run of words, and the item's words in tiles."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "item_words", F.col("tiled").alias("covered"), "longest")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.scored(table(spark, sf_dir, "documents")).where("is_spam").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's page score, the rate of its hosts, and the smoothed score."""
    return spam.scored(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        p1_found, p1_report, p2_found, p2_groups, p3_splits, p3_shares, p3_conflicts, p3_batches, p4_mix, p4_rows, p4_report, p5_pieces, p6_found, p6_texts, p6_report,
        p7_ids, p7_slices, p8_found, p8_items, p8_pairs, p9_found, p9_scores,
    ]
    return {f.__name__: f for f in own}


_PAIRS = f"""r as (select sample_id, list_filter(string_split_regex(lower(tool_output), '{WS}+'), lambda w: w <> '') as ws from canonical_rows),
big as (select sample_id, len(ws) as n, ws from r where len(ws) >= 8),
tf as (select sample_id, n, w, count(*) as k from (select sample_id, n, unnest(ws) as w from big) group by all),
near as (select a.sample_id as sample_id_a, b.sample_id as sample_id_b, sum(least(a.k, b.k)) / greatest(a.n, b.n) as shared from tf a join tf b on a.w = b.w and a.sample_id < b.sample_id and least(a.n, b.n) >= 0.75 * greatest(a.n, b.n)
  group by a.sample_id, b.sample_id, a.n, b.n having sum(least(a.k, b.k)) >= 0.75 * greatest(a.n, b.n))"""

_QUERY = f"""q as (select sample_id, split_name, list_filter(list_transform(string_split_regex(lower(query), '{WS}+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '') as ws from canonical_rows where split_name is not null),
qt as (select sample_id, w, count(*) as k from (select sample_id, unnest(ws) as w from q) group by all)"""

_CROSS = """c as (select sample_id_a, sample_id_b, case when a.split_name = 'train' then sample_id_b else sample_id_a end as eval_id, shared, a.ws as wa, b.ws as wb
  from near join q a on a.sample_id = sample_id_a join q b on b.sample_id = sample_id_b where (a.split_name = 'train') <> (b.split_name = 'train')),
both_ as (select sample_id_a, sample_id_b, coalesce(sum(case when y.k is null then 0 else least(x.k, y.k) end), 0) as common from c left join qt x on x.sample_id = sample_id_a left join qt y on y.sample_id = sample_id_b and y.w = x.w group by sample_id_a, sample_id_b),
fnd as (select sample_id_a, sample_id_b, eval_id from c join both_ using (sample_id_a, sample_id_b) where len(wa) - common <= 2 and len(wb) - common <= 2
  and list_sort(list_distinct(list_filter(wa, lambda w: regexp_matches(w, '[_/.0-9]')))) = list_sort(list_distinct(list_filter(wb, lambda w: regexp_matches(w, '[_/.0-9]')))))"""

_LEAK = """dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from documents where text is not null),
iw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from eval_items),
dg as (select distinct doc_id, list_aggregate(ws[i : i + 4], 'string_agg', ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from dw)),
ig as (select item_id, i, list_aggregate(ws[i : i + 4], 'string_agg', ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 3)) as i from iw)),
under as (select distinct doc_id, item_id, i + j as p from dg join ig using (g), range(0, 5) as t(j))"""


_MIX = """ln as (select *, mix_name || '|' || source || '|' || coalesce(tool_type, '') || '|' as nm from mix_targets),
rw as (select l.nm, c.sample_id, length(c.tool_output) as n, substr(md5(l.nm || c.sample_id), 1, 15) as pos from canonical_rows c join ln l on c.source = l.source and (l.tool_type = c.tool_type
  or (l.tool_type is null and not exists (select 1 from mix_targets o where o.mix_name = l.mix_name and o.source = l.source and o.tool_type = c.tool_type))) where length(c.tool_output) > 0),
tot as (select l.*, count(r.n) as available_rows, coalesce(sum(r.n), 0)::bigint as total from ln l left join rw r using (nm) group by all),
cap as (select nm, mix_name, total * max_repeats / target_share as r, target_share as s from tot where total > 0 and max_repeats > 0 and target_share > 0),
ranked as (select *, coalesce(sum(s) over (partition by mix_name order by r rows between unbounded preceding and 1 preceding), 0) as short, sum(s) over (partition by mix_name) as shares from cap),
lev as (select mix_name, max(r) as lev from ranked where short <= 0.1::double * shares + 1e-9 group by mix_name),
quo as (select t.*, least(total * max_repeats, coalesce(floor(lev * target_share + 1e-6), 0))::bigint as quota from tot t left join lev using (mix_name)),
rnd as (select *, case when total > 0 then quota // total else 0 end as rounds, case when total > 0 then quota % total else 0 end as rest from quo),
run as (select r.*, d.rounds, d.rest, sum(n) over (partition by r.nm order by pos) as upto from rw r join rnd d using (nm)),
mis as (select nm, any_value(rest) - coalesce(max(case when upto <= rest then upto end), 0) as missing from run group by nm),
ext as (select nm, arg_min(sample_id, (-n, pos)) as sample_id from run join mis using (nm) where upto > rest and n <= missing group by nm),
uses as (select run.*, run.rounds + (upto <= rest or e.sample_id is not null)::int as copies from run left join ext e on e.nm = run.nm and e.sample_id = run.sample_id)"""


_TILED = """n as (select doc_id, item_id, count(*) as n from under group by doc_id, item_id),
dp as (select doc_id, i, list_aggregate(ws[i : i + 4], 'string_agg', ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from dw)),
seed as (select doc_id, item_id, ig.i as p, dp.i - ig.i as diag from dp join ig using (g)),
isle as (select *, p - row_number() over (partition by doc_id, item_id, diag order by p) as k from seed),
lng as (select doc_id, item_id, max(c) + 4 as longest from (select doc_id, item_id, diag, k, count(*) as c from isle group by all) group by doc_id, item_id),
pairs as (select doc_id, item_id, cast(len(ws) as integer) as item_words, cast(n as integer) as covered, cast(longest as integer) as longest from n join iw using (item_id) join lng using (doc_id, item_id))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_rows": f"with {_MIX} select mix_name, source, tool_type, sample_id, cast(copies as integer) as copies from uses join ln using (nm) where copies > 0",
        "p4_report": f"""with {_MIX}, got as (select nm, count(*) as n_rows, sum(copies)::bigint as n_uses, max(copies)::bigint as most_uses, sum(n * copies)::bigint as chars from uses where copies > 0 group by nm),
mx as (select mix_name, greatest(sum(quota), 1) as all_planned, greatest(coalesce(sum(chars), 0), 1) as all_chars from rnd left join got using (nm) group by mix_name)
select mix_name, source, tool_type, target_share, max_repeats, available_rows, total as available_chars, quota as planned_chars, quota / all_planned as planned_share, coalesce(n_rows, 0) as n_rows,
  coalesce(n_uses, 0) as n_uses, coalesce(most_uses, 0) as most_uses, coalesce(chars, 0) as chars, coalesce(chars, 0) / all_chars as reached_share from rnd left join got using (nm) join mx using (mix_name)""",
        "p2_found": f"with {_PAIRS} select sample_id_a, sample_id_b from near",
        "p2_groups": f"""with recursive {_PAIRS}, cls as (select sample_id, min(sample_id) over (partition by list_sort(ws)) as rep from big),
lk as (select distinct a.rep as x, b.rep as y from near join cls a on a.sample_id = sample_id_a join cls b on b.sample_id = sample_id_b where a.rep <> b.rep), ln as (select x, y from lk union select y, x from lk),
reach as (select distinct rep as x, rep as y from cls union select r.x, ln.y from reach r join ln on ln.x = r.y), root as (select x, min(y) as group_id from reach group by x), deg as (select x, count(*) as links from ln group by x)
select c.sample_id, coalesce(rep, c.sample_id) as class_id, coalesce(group_id, c.sample_id) as group_id, coalesce(links, 0) as links from canonical_rows c left join cls using (sample_id) left join root on root.x = rep left join deg on deg.x = rep""",
        "p6_found": f"with {_PAIRS}, {_QUERY}, {_CROSS} select sample_id_a, sample_id_b from fnd",
        "p6_texts": f"""with {_PAIRS}, {_QUERY}, e as (select min(sample_id) as id from big join q using (sample_id) where split_name <> 'train' group by list_sort(big.ws)), t as (select min(sample_id) as id from big join q using (sample_id) where split_name = 'train' group by list_sort(big.ws))
select e.id as eval_id, t.id as train_id, round(shared, 4) as shared from near join e on e.id in (sample_id_a, sample_id_b) join t on t.id in (sample_id_a, sample_id_b)""",
        "p6_report": f"""with {_PAIRS}, {_QUERY}, {_CROSS}, best as (select eval_id as sample_id, max(shared) as shared from c group by eval_id), asked as (select eval_id as sample_id, count(*) as pairs from fnd group by eval_id)
select split_name, source, count(*) as rows, count(shared) as overlapping, count(pairs) as same_query, coalesce(sum(pairs), 0)::bigint as pairs, round(avg(shared), 4) as mean_shared
from canonical_rows left join best using (sample_id) left join asked using (sample_id) where split_name <> 'train' group by split_name, source""",
        "p8_pairs": f"with {_LEAK}, {_TILED} select doc_id, item_id, item_words, covered, longest from pairs",
        "p8_items": f"""with {_LEAK}, {_TILED} select item_id, count(distinct case when covered >= 0.5 * item_words then doc_id end) as documents, count(distinct case when covered < 0.5 * item_words then doc_id end) as partial,
round(max(covered / item_words), 4) as best_cover, max(longest) as longest_tile from pairs group by item_id""",
        "p8_found": f"with {_LEAK}, n as (select doc_id, item_id, count(*) as n from under group by doc_id, item_id) select doc_id, item_id from n join iw using (item_id) where n >= 0.5 * len(ws)",
    }
