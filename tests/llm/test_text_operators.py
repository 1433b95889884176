"""Truncation, tokens, leaks and spam: known answers, brute force, held-out accuracy, hostile rows."""

import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from lineloom.llm import leak, queries, spam, tokenise, truncation
from lineloom.runtime import table

HOSTILE = [None, "", "   ", "\n", "a", "x" * 150_000, "日本語のテキスト。", "emoji 😀 é ​ end", "it's 'quoted' don't 'll  \t x", "<|endoftext|>"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "web_page", "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, ids string, item_id int")


def test_tokens_equal_public_encoder(spark):
    import tiktoken

    ranks = tokenise.read_ranks(tokenise.DEFAULT_VOCABULARY)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    texts = HOSTILE + ["".join(rng.choice(list("ab 'sre\n\tvldm19é字.!\x1c\u0085²😀"), int(rng.integers(0, 40)))) for _ in range(2000)] + ["\U0010ffff 'll x\U0010ffff"]
    got = {r.doc_id: list(r.ids) for r in tokenise.token_ids(docs(spark, texts)).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_tokens_round_trip_and_offsets(spark, sf):
    pieces = tokenise.pieces_of(tokenise.read_ranks(tokenise.DEFAULT_VOCABULARY))
    text = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in queries.p7_slices(spark, sf).collect():
        t = text[r.doc_id] or ""
        assert tokenise.decode(r.ids, pieces) == t
        assert sum(r.slice_ids) == len(r.ids) and len(r.starts) == len(r.slice_ids)
        at = 0
        for s, e, n in zip(r.starts, [*r.starts[1:], len(t)], r.slice_ids):
            assert tokenise.decode(r.ids[at : at + n], pieces) == t[s:e]
            at += n
    assert tokenise.token_ids(docs(spark, []).limit(0)).count() == 0


def brute_leaks(texts, items):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for i, t in texts.items():
        w = words(t or "")
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, u in items.items():
            v = words(u or "")
            under = {k + d for k in range(len(v) - 4) if tuple(v[k : k + 5]) in grams for d in range(5)}
            if v and len(under) >= 0.5 * len(v):
                out.add((i, j))
    return out


def test_leaks_equal_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    items = {r.item_id: r.text for r in table(spark, sf, "eval_items").collect()}
    got = queries.p8_found(spark, sf).collect()
    assert {tuple(r) for r in got} == brute_leaks(texts, items) and len(got) == len(set(map(tuple, got)))


def test_leaks_reordered_repeated_and_hostile(spark, monkeypatch):
    w = [f"w{i}" for i in range(40)]
    item = " ".join(w)
    texts = [*HOSTILE, item, " ".join(w[20:]) + " gap " + " ".join(w[:20]), " ".join(w[:19]), item + " " + item, " ".join(w[:12] + ["x"] + w[8:20])]
    items = spark.createDataFrame([(1, item, "z"), (2, "too short", "z"), (3, None, "z"), (4, "", "z"), (5, " ".join(w[:10]), "z")], "item_id long, text string, doc_id string")
    df = docs(spark, texts)
    want = brute_leaks(dict(enumerate(texts)), {1: item, 5: " ".join(w[:10])})
    got = leak.leaks(df, items)
    assert {tuple(r) for r in leak.leaked(got).collect()} == want
    n = len(HOSTILE)
    row = got.where(f"doc_id = {n + 1} and item_id = 1").first()
    assert (row.tiles, row.tiled, row.reordered) == (2, 40, True)
    every = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(leak, "STEP_SEEDS", 3)
    assert sorted(map(tuple, leak.leaks(df, items).collect())) == every
    monkeypatch.setattr(leak, "BLOCK_WORDS", 10)  # joined by hashed runs
    assert sorted(map(tuple, leak.leaks(df, items).collect())) == every
    assert leak.leaks(df, items.limit(0)).count() == 0 and leak.leaks(df.limit(0), items).count() == 0


def test_items_report_partial_leaks(spark, tmp_path):
    w = [f"w{i}" for i in range(40)]
    docs(spark, [" ".join(w), " ".join(w[:7]) + " gap", "nothing", " ".join(w[:4])]).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(w)), (2, " ".join(w[:6] + ["y"] * 20)), (3, "not in any document at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = {r.item_id: (r.documents, r.partial, r.best_cover, r.longest_tile) for r in queries.p8_items(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, 1.0, 40), 2: (0, 2, 0.2308, 6)}
    assert {tuple(r) for r in queries.p8_found(spark, str(tmp_path)).collect()} == {(0, 1)}


def test_tiles_are_longest_first_and_disjoint():
    assert leak.tile([(0, 0, 10), (5, 20, 12)], 20) == [(5, 20, 12), (0, 0, 5)]
    assert leak.tile([(0, 0, 8), (3, 50, 6), (2, 3, 5)], 20) == [(0, 0, 8), (8, 55, 1)]


def test_cut_texts_on_made_lines(spark):
    rng = np.random.default_rng(3)
    nouns = ["anchor", "beacon", "copper", "drum", "engine", "funnel", "gasket", "hammer"]
    line = lambda: f"src/{rng.choice(nouns)}/{rng.choice(nouns)}.py:{rng.integers(1, 999)}: error: the {rng.choice(nouns)} must not {rng.choice(nouns)} a {rng.choice(nouns)}."
    rows, cut = [], set()
    for i in range(1500):
        text = "\n".join(line() for _ in range(int(rng.integers(3, 40))))
        if i % 5 == 0 and len(text) > 1000:
            text = text[:1000]
            while text[-1] in ".\n":
                text = text[:-1] + "x"
            cut.add(i)
        elif i % 5 == 1:
            text = text + "\n... (12 more lines omitted)"
        rows.append((i, text, "grep", "swe", 1))
    n = len(rows)
    rows += [(n + k, t, "grep", "swe", 1) for k, t in enumerate(HOSTILE)] + [(n + 50, "text", None, None, 1)]
    df = spark.createDataFrame(rows, "sample_id long, tool_output string, tool_type string, source string, id int")
    got, limits = truncation.cut_rows(df)
    flagged = {r.id for r in got.where("log_odds > 0").collect()}
    assert got.count() == len(rows)
    assert (("swe", 1000) in {x[:2] for x in limits}) and len(flagged & cut) >= 0.97 * len(cut)
    assert len([i for i in flagged if i < n and i not in cut]) <= 0.01 * n and not flagged & {n, n + 1, n + 2, n + 3}
    assert truncation.cut_rows(df.limit(0))[0].count() == 0


def test_censored_fit_recovers_parameters():
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(7.5, 0.6, 40_000)).astype(int) + 1
    limited = rng.random(len(x)) < 0.3
    x = np.where(limited & (x > 2000), 2000, x)
    mu, sd, post = truncation.fit_censored(len(x), float(np.log(x).sum()), float((np.log(x) ** 2).sum()), [(2000.0, float((x == 2000).sum()))])
    assert abs(mu - 7.5) < 0.03 and abs(sd - 0.6) < 0.03 and post[2000.0] > 0.98


def test_short_limits_are_found_and_frequent_texts_are_none(spark):
    rng = np.random.default_rng(8)
    made = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    texts = [made(int(np.exp(rng.normal(5.5, 0.7))) + 1) for _ in range(2000)]
    texts = [t[:120] if len(t) > 120 and i % 4 == 0 else t for i, t in enumerate(texts)] + ["nothing to do"] * 500
    rows = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, source string, text string")
    fits, limits = truncation.length_model(truncation.lengths(rows))
    assert [(s, n) for s, n, _, _ in limits] == [("s", 120)] and limits[0][3] > 0.9 and fits["s"][2] == len(set(texts))


def test_calibration_recovers_scale():
    rng = np.random.default_rng(9)
    t = rng.normal(0, 2, 20_000)
    y = (rng.random(len(t)) < 1 / (1 + np.exp(-t))).astype(float)
    scale, offset = truncation.calibration(2.5 * t + 1, y, np.ones(len(t)))
    assert abs(scale - 0.4) < 0.03 and abs(offset + 0.4) < 0.1


@pytest.mark.parametrize(
    "text,line,note",
    [("a\nb c", "b c", ""), ("a\nb c\n... (3 more lines omitted)\n", "b c", "omitted"), ("a\nb c\npipe closed by remote side", "b c", "broken"), ("\x1b[31ma\x1b[0m", "a", ""), ("", "", "")],
)
def test_final_line(text, line, note):
    assert truncation.final_line(text) == (line, note)


@pytest.mark.parametrize("note", ["<stream ended early>", "[connection lost]", "*** transfer aborted ***", "curl: (18) transfer closed with 312 bytes remaining to read", "Connection reset after 4096 bytes"])
def test_final_line_before_framed_and_numbered_notes(note):
    assert truncation.final_line(f"a\nsrc/vec\n{note}\n") == ("src/vec", "broken")


def test_long_lines_are_taken_whole():
    long = '{"a": [' + ", ".join(f'"w{i}"' for i in range(8000)) + "]}"
    assert len(long) > 40_000 and truncation.final_line(f"x\n{long}\n") == (long, "")
    sample = next(truncation._sample_lines(iter([pd.DataFrame({"row": [1], "tool": ["t"], "text": [f"{long}\n{long}"], "plain": [True]})])))
    assert list(sample.line) == [long, long]


def test_line_before_what_may_be_a_note():
    for last, before in [("recv_loop: lost 3 frames", "src/vec"), ("Nobody has lost 3 rows.", "src/vec"), ("b = 1", "")]:
        text = f"a\nsrc/vec\n{last}"
        assert truncation.final_line(text) == (last, "") and truncation.line_before(text, last, "") == before


def test_spam_held_out_accuracy():
    rng = np.random.default_rng(6)
    nouns = [f"noun{i}" for i in range(60)]
    def prose():
        return "\n\n".join(" ".join(f"The {rng.choice(nouns)} of {rng.choice(nouns)} can help {rng.choice(nouns)} when it is {rng.choice(nouns)}." for _ in range(4)) for _ in range(4))
    def code():
        return "\n".join(f"    self.{rng.choice(nouns)} = {rng.choice(nouns)}({rng.choice(nouns)}, key='{rng.choice(nouns)}')" for _ in range(20))
    def stuffed():
        p = [f"cheap {rng.choice(nouns)}" for _ in range(3)]
        return ", ".join(rng.choice(p) for _ in range(60))
    def links():
        return "\n".join(f"Top » {rng.choice(nouns)}{rng.integers(99)}.example/{rng.choice(nouns)}" for _ in range(25))
    def tags():
        return " ".join(f"#{rng.choice(nouns)}_{rng.choice(nouns)}" for _ in range(40))
    texts = [f() for _ in range(60) for f in (prose, code, stuffed, links, tags)]
    y = np.array([0, 0, 1, 1, 1] * 60)
    x = np.array([spam.features(t)[0] for t in texts], np.float32)
    trees = spam.train(x[:200])
    assert ((spam.page(trees, x[200:]) > spam.THRESHOLD) == y[200:]).mean() >= 0.98
    assert len(spam.features("")[0]) == len(spam.FEATURES) and spam.page(trees, np.array([spam.features("")[0]])) == [0]


def test_features_name_hosts_and_explained_links():
    x, hosts = spam.features("See https://a.example/x?q=1 and b.test for more words. It explains all that.\nwww.c.invalid\nplain")
    f = dict(zip(spam.FEATURES, x))
    assert hosts == ["a.example", "b.test", "c.invalid"] and f["url_lines"] == 2 / 3 and f["explained"] == 0.5


def test_hosts_move_verdicts(spark):
    rows = [(i, 0.9, ["bad.example"]) for i in range(40)] + [(i, 0.02, ["good.example"]) for i in range(40, 300)] + [(300, 0.2, ["bad.example"]), (301, 0.3, ["good.example"]), (302, 0.2, ["own.example"]), (303, 0.3, [])]
    got = {r.id: r for r in spam.smoothed(spark.createDataFrame(rows, "id long, page double, hosts array<string>")).collect()}
    assert [got[i].is_spam for i in (300, 301, 302, 303)] == [True, False, False, True]
    assert got[302].host_rate is None and got[303].score == 0.3 and len(got) == len(rows)


def test_spam_of_hostile_rows(spark):
    texts = HOSTILE + ["cheap anchor, cheap anchor, buy anchor, cheap anchor, " * 20] * 30 + ["This is one of the sentences that a person could write about work. Another one explains why it is so."] * 30
    got = {r.doc_id: r.is_spam for r in spam.scored(docs(spark, texts)).collect()}
    n = len(HOSTILE)
    assert got.keys() == set(range(len(texts))) - {0}
    assert all(got[n + k] for k in range(30)) and not any(got[n + 30 + k] for k in range(30)) and not got[1] and not got[2]
    assert spam.scored(docs(spark, []).limit(0)).count() == 0
