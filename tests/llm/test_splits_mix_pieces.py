"""Splits, mixes and pieces: invariants on the tables and on hostile rows."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import mixing, pieces, queries, splits
from lineloom.runtime import table

TARGETS = [("train", 0.8), ("dev", 0.1), ("test", 0.1)]


def records(spark, rows):
    return spark.createDataFrame(rows, "id long, keys array<string>, was string")


def test_every_row_once_and_groups_together(spark, sf):
    rows = {r.sample_id: r for r in table(spark, sf, "canonical_rows").collect()}
    got = {r.sample_id: r.split_name for r in queries.p3_splits(spark, sf).collect()}
    assert got.keys() == rows.keys() and set(got.values()) <= {"train", "dev", "test"}
    flat = lambda x: "-".join("".join(c if c.isalnum() else " " for c in x.lower()).split()).rsplit("-", 1)[0]
    by_repo, by_id = defaultdict(set), defaultdict(set)
    for r in rows.values():
        if r.source == "swe":
            by_repo[flat(r.instance_id)].add(got[r.sample_id])
        by_id[r.instance_id.strip().lower()].add(got[r.sample_id])
    assert all(len(s) == 1 for s in by_repo.values())
    for r in rows.values():
        if r.source == "synthetic_negative":
            o = r.output_origin_instance_id
            there = by_id.get(o.strip().lower()) if o.startswith("synthetic") else by_repo.get(flat(o))
            assert there is None or there == {got[r.sample_id]}


def test_shares_of_new_components_and_one_hot_key(spark):
    rows = [(i, ["hot"] if i % 3 == 0 else [f"k{i}"], None) for i in range(3000)]
    assigned, state, bad = splits.update(records(spark, rows), TARGETS)
    n = {r.split: r["count"] for r in assigned.groupBy("split").count().collect()}
    assert all(abs(n[s] / 3000 - t) < 0.02 for s, t in TARGETS)
    assert assigned.where("keys is not null" if "keys" in assigned.columns else "true").count() == 3000 and bad.count() == 0
    assert state.where("key = 'hot'").count() == 1


def test_update_keeps_old_splits_and_quarantines_conflicts(spark):
    first, state, _ = splits.update(records(spark, [(i, ["a"], "train") for i in range(5)] + [(10, ["b"], "test"), (11, ["c"], "test")]), TARGETS)
    assert {r.id: r.split for r in first.collect()} == {**{i: "train" for i in range(5)}, 10: "test", 11: "test"}
    second, after, bad = splits.update(records(spark, [(20, ["a", "b"], None), (21, ["c", "d"], None), (22, ["e"], None), (23, [], None), (24, None, None)]), TARGETS, state)
    got = {r.id: (r.split, r.status) for r in second.collect()}
    assert got[20] == ("train", "quarantined") and got[21] == ("test", "kept")
    assert got[22][1] == got[23][1] == got[24][1] == "new"
    assert [sorted(r.splits) for r in bad.collect()] == [["test", "train"]]
    keys = {r.key: (r.component, r.split) for r in after.collect()}
    assert keys["a"][1] == "train" and keys["b"][1] == "test" and keys["c"] == keys["d"] and keys["c"][1] == "test"


def test_moved_rows_and_empty_input(spark):
    got, _, _ = splits.update(records(spark, [(1, ["a"], "train"), (2, ["a"], "train"), (3, ["a"], "test"), (4, ["a"], None), (5, ["a"], "nonsense")]), TARGETS)
    assert {r.id: (r.split, r.status) for r in got.collect()} == {1: ("train", "kept"), 2: ("train", "kept"), 3: ("train", "moved"), 4: ("train", "kept"), 5: ("train", "kept")}
    got, state, bad = splits.update(records(spark, []), TARGETS)
    assert got.count() == state.count() == bad.count() == 0


def test_conflicts_of_earlier_splits_are_quarantined(spark, sf):
    rows = [(1, ["a"], "train"), (2, ["a"], "train"), (3, ["a"], "test"), (4, ["b"], "dev")]
    got, _, bad = splits.update(records(spark, rows), TARGETS, conflicts=True)
    assert {r.id: (r.split, r.status) for r in got.collect()} == {1: ("train", "quarantined"), 2: ("train", "quarantined"), 3: ("train", "quarantined"), 4: ("dev", "kept")}
    assert [(r.splits, r.n_rows) for r in bad.collect()] == [(["test", "train"], 3)]
    marked = {r.component for r in queries.p3_splits(spark, sf).where("status = 'quarantined'").collect()}
    assert marked == {r.component for r in queries.p3_conflicts(spark, sf).collect()}


def test_component_table_is_kept_and_advanced(spark, tmp_path):
    path = str(tmp_path / "splits")
    first = [(i, ["a"], "train") for i in range(5)] + [(10, ["b"], "test"), (11, [], None)]
    got = lambda rows: {r.id: (r.split, r.status) for r in splits.advance(records(spark, rows), TARGETS, path)[0].collect()}
    one = got(first)
    assert one[0] == ("train", "kept") and one[10] == ("test", "kept") and one[11][1] == "new" and len(one) == 7
    assert got(first) == one and not (tmp_path / "splits" / "2").exists()
    two = got([*first, (20, ["a", "b"], None), (21, ["b"], None)])
    assert {i: two[i] for i in one} == one and two[20] == ("train", "quarantined") and two[21] == ("test", "kept") and len(two) == 9
    assigned, bad = splits.advance(records(spark, first), TARGETS, path)
    assert assigned.count() == 7 and [(r.splits, r.n_rows) for r in bad.collect()] == [(["test", "train"], 8)]


def test_new_keys_of_a_held_merge_follow_the_larger_component(spark):
    _, state, _ = splits.update(records(spark, [(i, ["a"], "train") for i in range(5)] + [(10, ["b"], "test")]), TARGETS)
    rows = [(20, ["a", "x"], None), (21, ["x", "b"], None), (22, ["x"], None), (23, ["b"], None)]
    got, after, bad = splits.update(records(spark, rows), TARGETS, state)
    got = {r.id: (r.split, r.status) for r in got.collect()}
    assert got == {20: ("train", "quarantined"), 21: ("train", "quarantined"), 22: ("train", "quarantined"), 23: ("test", "kept")}
    keys = {r.key: (r.component, r.split) for r in after.collect()}
    assert keys["x"] == keys["a"] and keys["b"][1] == "test" and bad.count() == 1
    again, _, bad = splits.update(records(spark, [(30, ["x", "a"], None), (31, ["b"], None)]), TARGETS, after)
    assert {r.id: (r.split, r.status) for r in again.collect()} == {30: ("train", "kept"), 31: ("test", "kept")} and bad.count() == 0


def test_batches_keep_what_earlier_ones_decided(spark, sf):
    got = {r.sample_id: r for r in queries.p3_batches(spark, sf).collect()}
    rows = {r.sample_id: r for r in table(spark, sf, "canonical_rows").collect()}
    assert got.keys() == rows.keys() and {r.batch for r in got.values()} == {1, 2}
    one = {r.sample_id: r.split_name for r in queries.p3_splits(spark, sf).collect()}
    assert sum(one[i] == r.split_name for i, r in got.items()) >= 0.9 * len(got)


def test_repository_spellings(spark):
    ids = ["org__my-repo-12", "ORG__MY-REPO-13", "org/my-repo-14", " org__my-repo-15 "]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    assert {r[0] for r in df.select(splits.repo_key(F.col("i"))).collect()} == {"repo:org-my-repo"}


T = "mix_name string, source string, tool_type string, target_share double, max_repeats int"


def test_mix_meets_shares_and_repeats(spark, sf):
    rows = table(spark, sf, "canonical_rows")
    targets = spark.createDataFrame([("m", "swe", None, 0.6, 1), ("m", "synthetic", None, 0.4, 4)], T)
    got = mixing.mix(rows, targets, shards=4).collect()
    size = {r.sample_id: len(r.tool_output) for r in rows.collect()}
    uses = defaultdict(list)
    for r in got:
        uses[r.source, r.sample_id].append(r.copy)
        assert r.n_chars == size[r.sample_id] and 0 <= r.shard < 4
    assert all(sorted(c) == list(range(len(c))) and len(c) <= {"swe": 1, "synthetic": 4}[s] for (s, _), c in uses.items())
    for r in mixing.report(*mixing.planned(rows, targets)).collect():
        assert abs(r.reached_share - r.target_share) < 0.01 and r.chars <= r.planned_chars
        assert sum(x.n_chars for x in got if x.source == r.source) == r.chars
    assert {r.shard for r in got} == {0, 1, 2, 3}


def test_short_and_absent_lines_give_what_they_have(spark):
    rows = spark.createDataFrame([(i, "a" if i < 400 else "b" if i < 800 else "c", "t" if i % 2 else "u", "x" * (50 + i % 7)) for i in range(801)], "sample_id long, source string, tool_type string, tool_output string")
    targets = spark.createDataFrame([("m", "a", None, 0.5, 1), ("m", "b", "t", 0.3, 2), ("m", "c", "u", 0.05, 3), ("m", "gone", None, 0.15, 9)], T)
    used, lines = mixing.planned(rows, targets)
    by = {r.source: r for r in mixing.report(used, lines).collect()}
    assert by["gone"].chars == 0 == by["gone"].reached_share and by["c"].n_uses == 3 == by["c"].most_uses
    rest = 1 - by["c"].reached_share
    assert abs(by["a"].reached_share - rest * 0.5 / 0.8) < 0.005 and abs(by["b"].reached_share - rest * 0.3 / 0.8) < 0.005
    for size in (3_000, 20_000, 10**9):
        out = mixing.report(*mixing.planned(rows, targets, size=size)).collect()
        assert all(r.most_uses <= r.max_repeats for r in out)
        total = sum(r.chars for r in out)
        assert size - 300 < total <= size if size < 10**9 else total == sum(r.available_chars * r.max_repeats for r in out)


def test_part_round_is_found_by_nested_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 3)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = spark.createDataFrame([(0, i, n, p) for i, (n, p) in enumerate([(5, 7), (3, 9), (4, 9), (10, 2**40), (1, 2**59), (9, 2**59 + 1)])] + [(1, 9, 4, 3)], "line int, id long, n long, pos long")
    for rest, want in ((4, (6, 4)), (5, (8, 0)), (11, (8, 6)), (12, (2**40 - 1, 0)), (23, (2**59, 0)), (25, (2**59, 2))):
        last, missing = mixing._part_rounds(rows, {0: rest})[0]
        taken = [r.n for r in rows.where(f"line = 0 and pos <= {last}").collect()]
        assert sum(taken) == rest - missing == rest - want[1]


def test_shards_are_written_in_their_order(spark, sf, tmp_path):
    mixed = mixing.mix(table(spark, sf, "canonical_rows"), table(spark, sf, "mix_targets"), shards=3)
    mixing.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("sample_id", "copy", "place").collect())) == sorted(map(tuple, mixed.select("sample_id", "copy", "place").collect()))


def test_mix_of_hostile_rows(spark):
    schema = "sample_id long, source string, tool_type string, tool_output string, line int, n int, pos int, copies int"
    rows = spark.createDataFrame([(1, "a", "t", None, 1, 1, 1, 1), (2, "a", "t", "", 1, 1, 1, 1), (3, "a", None, "xx" * 50, 1, 1, 1, 1), (4, "b", "t", "y" * 100, 1, 1, 1, 1), (5, None, "t", "z", 1, 1, 1, 1)], schema)
    targets = spark.createDataFrame([("m", "a", None, 0.5, 2), ("m", "b", "t", 0.5, 2)], T)
    assert sorted((r.sample_id, r.copy) for r in mixing.mix(rows, targets).collect()) == [(3, 0), (3, 1), (4, 0), (4, 1)]
    # a row of its own tool's line isn't in that of any tool; rows of one id go together
    both = spark.createDataFrame([("m", "a", None, 0.5, 2), ("m", "a", "t", 0.5, 2)], T)
    again = rows.unionByName(rows.where("sample_id = 4").withColumn("source", F.lit("a"))).unionByName(rows.where("sample_id = 3"))
    got = mixing.mix(again, both).groupBy("tool_type", "sample_id").count().collect()
    assert {(r.tool_type, r.sample_id): r["count"] for r in got} == {(None, 3): 2, ("t", 4): 2}
    assert mixing.mix(rows, spark.createDataFrame([], T)).count() == 0
    assert mixing.mix(rows.limit(0), spark.createDataFrame([("m", "a", None, 1.0, 2)], T)).count() == 0


def test_splitting_tree_is_exact():
    counts = np.array([10, 0, 257, 3])
    tree = mixing.split_tree(counts, 7, np.random.default_rng(1))
    assert len(tree) == 7 and (sum(tree) == counts).all() and max(x.sum() for x in tree) - min(x.sum() for x in tree) <= 2


LIMITS = "tool_type string, max_chars int, overlap_chars int"


def check_pieces(text, got, most, overlap, spans=()):
    got = sorted(got, key=lambda r: r.piece)
    assert got[0].start == 0 and got[-1].end == len(text)
    held = set()
    for r in got:
        assert r.piece_text == text[r.start : r.end] and 0 < len(r.piece_text) <= most
        assert r.first_line == text[: r.start].count("\n") + 1
        assert r.last_line == text[: r.end - 1].count("\n") + 1 if r.end else 1
        for s in r.gold:
            held |= set(range(s.start_line, s.end_line + 1))
    for a, b in zip(got, got[1:]):
        assert a.end - b.start >= overlap and b.end > a.end and a.start <= b.start
    return held


@pytest.mark.parametrize("most,overlap", [(40, 0), (40, 10), (100, 30)])
def test_pieces_of_hostile_texts(spark, most, overlap):
    rng = np.random.default_rng(most + overlap)
    texts = ["".join(rng.choice(list("ab c\n\n.é😀\r"), 400)) for _ in range(30)] + ["x" * 500, "\n" * 300, "long " * 100, "a\r\n" * 120, "😀" * 300, "short", "", None, "y" * 10 + "\n" + "z" * 300, "é" * 100 + "é" * 100]
    rows = spark.createDataFrame([(i, t, "t", [(3, 5), (9, 2), (4, 999)], 1) for i, t in enumerate(texts)], "sample_id long, tool_output string, tool_type string, gold_spans array<struct<start_line:int,end_line:int>>, piece int")
    got = defaultdict(list)
    for r in pieces.pieces(rows, spark.createDataFrame([(None, most, overlap)], LIMITS)).collect():
        got[r.sample_id].append(r)
    for i, t in enumerate(texts):
        if t and len(t) > most:
            check_pieces(t, got[i], most, overlap)
        else:
            assert i not in got


def test_pieces_break_at_line_ends_and_hold_gold_lines(spark):
    text = "\n".join(f"line {i:03d} " + "w" * 20 for i in range(100))
    rows = spark.createDataFrame([(1, text, "x", [(1, 2), (50, 51)])], "sample_id long, tool_output string, tool_type string, gold_spans array<struct<start_line:int,end_line:int>>")
    got = pieces.pieces(rows, spark.createDataFrame([("x", 600, 60), (None, 10, 0)], LIMITS)).collect()
    assert check_pieces(text, got, 600, 60) == {1, 2, 50, 51}
    assert all(r.piece_text.endswith("\n") for r in got if r.end < len(text)) and all(r.start == 0 or text[r.start - 1] == "\n" for r in got)


def test_pieces_of_the_tables(spark, sf):
    limits = {r.tool_type: r for r in table(spark, sf, "piece_limits").collect()}
    rows = {r.sample_id: r for r in table(spark, sf, "canonical_rows").collect()}
    got = defaultdict(list)
    for r in queries.p5_pieces(spark, sf).collect():
        got[r.sample_id].append(r)
    for i, r in rows.items():
        lim = limits.get(r.tool_type) or limits[None]
        if len(r.tool_output) > lim.max_chars:
            check_pieces(r.tool_output, got.pop(i), lim.max_chars, lim.overlap_chars)
    assert not got


def test_a_limit_must_exceed_its_overlap():
    with pytest.raises(ValueError):
        pieces.cut_pattern(10, 10)
