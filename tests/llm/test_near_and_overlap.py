"""Near-duplicates and cross-split overlaps against brute force, and on hostile rows."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lineloom.llm import near_dup, overlap, splits
from lineloom.runtime import table

ROWS = "sample_id long, tool_output string, query string, split_name string, source string, id int, text string, a int, n int"


def share(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    n, m = x.total(), y.total()
    return min(n, m) >= 8 and (x & y).total() >= 0.75 * max(n, m)


def found(df):
    return {tuple(r) for r in df.collect()}


def test_pairs_equal_brute_force(spark, sf):
    rows = table(spark, sf, "canonical_rows").select("sample_id", "tool_output").collect()
    want = {(a.sample_id, b.sample_id) for a, b in combinations(sorted(rows), 2) if share(a.tool_output, b.tool_output)}
    got = near_dup.near_pairs(table(spark, sf, "canonical_rows")).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and want


def hostile(spark):
    base = " ".join(f"word{i}" for i in range(40))
    texts = [base, base.upper(), base + " extra", " ".join(reversed(base.split())), None, "", "   ", "too few words", "same " * 30, "same " * 29, "x" * 200_000, base + " 日本語 😀"]
    return spark.createDataFrame([(i, t, "Find a_b now", "train" if i % 2 else "test", "swe", 1, "t", 2, 3) for i, t in enumerate(texts)], ROWS), texts


def test_nulls_copies_and_clashing_columns(spark):
    df, texts = hostile(spark)
    want = {(i, j) for (i, a), (j, b) in combinations(enumerate(texts), 2) if a and b and share(a, b)}
    assert found(near_dup.near_pairs(df)) == want
    assert found(near_dup.near_pairs(df.limit(0))) == set()


def test_hot_bucket_is_joined_as_a_grid(spark):
    rows = [(7, i, 100, 0) for i in range(60)] + [(8, 100 + i, 100, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "bucket long, id long, n int, s1 long")
    want = set(combinations(range(60), 2)) | set(combinations(range(100, 103), 2))
    assert found(near_dup.bucket_pairs(df, block=7)) == want == found(near_dup.bucket_pairs(df, block=500))


def test_classes_are_expanded_as_a_grid(spark):
    members = spark.createDataFrame([(i, 0) for i in range(30)] + [(100 + i, 100) for i in range(11)] + [(500, 500)], "id long, rep long")
    links = spark.createDataFrame([(0, 100), (100, 500)], "a long, b long")
    x, y = range(30), range(100, 111)
    want = set(combinations(x, 2)) | set(combinations(y, 2)) | {(a, b) for a in x for b in y} | {(b, 500) for b in y}
    for block in (4, 500):
        got = near_dup.expand(members, links, block).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("jaccard", [0.3, 0.6, 0.9])
def test_sketch_agrees_with_probability_of_similarity(jaccard):
    rng = np.random.default_rng(1)
    union = rng.integers(0, 2**63, 200).astype(np.uint64)
    k = int(200 * jaccard)
    both, rest = union[:k], union[k:]
    a, b = np.concatenate([both, rest[::2]]), np.concatenate([both, rest[1::2]])
    row = np.repeat([0, 1], [len(a), len(b)])
    s = near_dup.sketch(row, np.concatenate([a, b]), 2, 2000)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - jaccard) < 0.05


def test_sketch_of_one_element_fills_every_bin():
    s = near_dup.sketch(np.array([0, 1]), np.array([5, 5], np.uint64), 2)
    assert (s[0] == s[1]).all() and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def brute_overlaps(rows):
    out = set()
    for a, b in combinations(sorted(rows, key=lambda r: r.sample_id), 2):
        if a.split_name and b.split_name and (a.split_name == "train") != (b.split_name == "train"):
            if a.tool_output and b.tool_output and share(a.tool_output, b.tool_output) and overlap.near_queries(overlap.query_words(a.query), overlap.query_words(b.query)):
                out.add((a.sample_id, b.sample_id))
    return out


def pairs_of(df):
    members, pairs = overlap.near_texts(df)
    rows = overlap.same_queries(members, pairs, df).collect()
    got = {tuple(sorted((r.eval_id, r.train_id))) for r in rows}
    assert len(got) == len(rows)
    return got


def test_overlaps_equal_brute_force(spark, sf):
    df = table(spark, sf, "canonical_rows")
    assert pairs_of(df) == brute_overlaps(df.select("sample_id", "tool_output", "query", "split_name").collect())


def test_overlaps_of_hostile_rows(spark, monkeypatch):
    df, _ = hostile(spark)
    want = brute_overlaps(df.collect())
    assert want and pairs_of(df) == want
    for name, value in (("EVAL_WORDS", 30), ("TRAIN_WORDS", 30), ("BLOCK", 1)):  # grids of buckets and of shards
        monkeypatch.setattr(overlap, name, value)
    assert pairs_of(df) == want
    assert pairs_of(df.unionByName(df)) == want and pairs_of(df.limit(0)) == set()
    members, pairs = overlap.near_texts(df)
    out = overlap.report(members, pairs, overlap.same_queries(members, pairs, df), df).where("split_name = 'test'").first()
    assert out.overlapping >= out.same_query > 0


def test_overlaps_are_found_under_other_queries(spark):
    base = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, base, "find a/b", "train", "swe"), (2, base + " x", "count the c_d", "test", "swe"), (3, base.upper(), None, "dev", "swe"), (4, base, "find a/b", None, "swe")], "sample_id long, tool_output string, query string, split_name string, source string")
    members, pairs = overlap.near_texts(df)
    assert {(r.eval_id, r.train_id): (round(r.cover, 3), round(r.shared, 3)) for r in pairs.collect()} == {(2, 1): (round(40 / 41, 3), round(40 / 41, 3)), (3, 1): (1.0, 1.0)}
    found = overlap.same_queries(members, pairs, df)
    assert found.count() == 0
    got = {r.split_name: (r.rows, r.overlapping, r.same_query, r.pairs) for r in overlap.report(members, pairs, found, df).collect()}
    assert got == {"test": (1, 1, 0, 0), "dev": (1, 1, 0, 0)}


def test_reordered_and_edited_passages_are_covered():
    text = "\n".join(f"src/path{i}.py has {i}" for i in range(20))
    assert overlap.Passages([(1, text), (2, "other")]).cover("\n".join(reversed(text.split("\n")))) == [(1, 1.0, 1.0)]
    words = [f"w{i}" for i in range(40)]
    p = overlap.Passages([(1, " ".join(words))])
    assert p.cover(" ".join(w if i % 4 else "new" for i, w in enumerate(words))) == [(1, 0.75, 0.75)]
    assert p.cover(" ".join(w if i % 2 else "new" for i, w in enumerate(words))) == [(1, 0.5, 0.0)]
    assert overlap.Passages([]).cover("a b c") == [] == overlap.Passages([(1, "")]).cover("a")


def test_query_words():
    a, b = overlap.query_words("Find `a_b.c`, now!"), overlap.query_words("find a_b.c please now")
    assert a[0] == ("a_b.c",) and overlap.near_queries(a, b)
    assert not overlap.near_queries(a, overlap.query_words("find a_b.d now"))
    assert not overlap.near_queries(a, overlap.query_words("find a_b.c now one two three"))
    assert overlap.query_words(None) == ((), Counter())


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 50)]
    df = spark.createDataFrame(chain + star + chain, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 50), *range(100, 161), 999]], "node long")
    got = dict(map(tuple, splits.components(df, nodes).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 50)} == {1} and got[999] == 999


def test_texts_at_the_threshold_are_all_found(spark):
    """Pairs of 40 words of which just 30 are shared: the farthest apart that are near-same; one word less is no case."""
    rows = []
    for i in range(500):
        both = [f"both{i}_{k}" for k in range(30)] if i % 5 else [f"common{k}" for k in range(25)] + [f"both{i}_{k}" for k in range(5)]
        for side, split in enumerate(("train", "test")):
            rows.append((2 * i + side, " ".join(both + [f"own{i}_{side}_{k}" for k in range(10)]), "find a/b", split, "swe"))
        rows.append((10_000 + i, " ".join(both[1:] + [f"other{i}_{k}" for k in range(11)]), "find a/b", "train", "swe"))
    df = spark.createDataFrame(rows, "sample_id long, tool_output string, query string, split_name string, source string")
    want = {(2 * i, 2 * i + 1) for i in range(500)}
    assert pairs_of(df) == want


def test_only_texts_that_may_have_partners_are_shipped(spark):
    """Shuffled is a quarter of what two texts share, not a fixed number of hashes for every text; hot elements meet apart."""
    alone = [(i, " ".join(f"alone{i}_{k}" for k in range(40))) for i in range(30)]
    df = spark.createDataFrame(alone, "id long, text string")
    _, order = near_dup.keyed(df, "id", "text")
    assert near_dup.places(near_dup.prefixed(df, "id", "text", order)).count() == 0
    twins = [(100 + i, " ".join(f"twin{i % 20}_{k}" for k in range(40)) + f" own{i}") for i in range(60)]
    df = spark.createDataFrame(alone + twins, "id long, text string")
    _, order = near_dup.keyed(df, "id", "text")
    want = {(a, b) for a, b in combinations(range(100, 160), 2) if (b - a) % 20 == 0}
    for block in (2, 500):
        placed = near_dup.places(near_dup.prefixed(df, "id", "text", order, block=block))
        assert placed.count() == 60 * 12
        assert {(r.a, r.b) for r in near_dup.bucket_pairs(placed, block).collect()} == want


def test_ids_that_are_far_apart(spark):
    """Ids that agree in their lowest bits stand in one place of the bitmaps."""
    words = " ".join(f"word{i}" for i in range(40))
    step = 1 << near_dup.WANTED_BITS
    texts = {5: words, 5 + step: words + " more", 5 - step: words, 5 + 3 * step: words.upper() + " more", 6: "other " * 20}
    df = spark.createDataFrame(list(texts.items()), "sample_id long, tool_output string")
    assert found(near_dup.near_pairs(df)) == {(a, b) for a, b in combinations(sorted(texts), 2) if share(texts[a], texts[b])}
