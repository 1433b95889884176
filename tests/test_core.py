"""Known answers, invariants and differential tests of the core operators."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lineloom import runtime
from lineloom.functions import arrays
from lineloom.functions import text as X
from lineloom.operators import audit, calls, dataset, gates, metrics, patches, rank, scoring, sessions, windows
from lineloom.operators import lines as L
from lineloom.operators import spans as S
from lineloom.runtime import ranked
from lineloom.sources import tables as T

SPANS = "array<struct<start_line:int,end_line:int>>"


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first().v


def spans_of(v):
    return [(s.start_line, s.end_line) for s in v]


def merged(spans, n):
    out = []
    for a, b in sorted((max(1, a), min(n, b)) for a, b in spans if a is not None and b is not None):
        if a > b:
            continue
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_spans_merge_like_a_sweep(spark):
    rng = random.Random(1)
    rows = [(i, [(rng.randint(-3, 30), rng.randint(-3, 30)) for _ in range(rng.randint(0, 6))], rng.randint(1, 25)) for i in range(200)]
    rows += [(900, [(5, 7), (1, 2), (3, 3), (7, 9)], 100), (901, None, 5), (902, [(None, 3), (2, None), (2, 2)], 5)]
    df = spark.createDataFrame(rows, f"id int, s {SPANS}, n int").select("id", S.normalise(F.col("s"), F.col("n")).alias("v"))
    got = {r.id: spans_of(r.v) for r in df.collect()}
    assert got == {i: merged(s or [], n) for i, s, n in rows} and got[900] == [(1, 3), (5, 9)] and got[901] == []


def test_islands_and_extraction(spark):
    assert spans_of(one(spark, rank.islands(F.array(*(F.lit(i) for i in (1, 2, 3, 7, 9, 10)))))) == [(1, 3), (7, 7), (9, 10)]
    text = F.lit("a\nb\nc\nd\ne\nf")
    kept = S.normalise(F.from_json(F.lit('[{"start_line":2,"end_line":3},{"start_line":5,"end_line":5}]'), SPANS), F.lit(6))
    assert one(spark, S.extract(text, kept)) == ["b", "c", "e"]
    assert one(spark, L.kept_text(text, kept)) == "... (1 lines omitted)\nb\nc\n... (1 lines omitted)\ne\n... (1 lines omitted)"
    assert one(spark, L.kept_text(text, S.normalise(F.lit(None).cast(SPANS), F.lit(6)))) == ""


def test_lines_views(spark):
    assert one(spark, L.numbered(F.lit("a\n\nb"))) == "1: a\n2: \n3: b"
    assert one(spark, L.truncated(F.lit("a\nb\nc"), 2)) == "a\nb\n... (1 more lines omitted)" and one(spark, L.truncated(F.lit("a"), 2)) == "a"
    got = [(r.line, r.start, r.stop) for r in L.offsets(spark.createDataFrame([("ab\n\né😀x",)], "t string"), "t", []).orderBy("line_no").collect()]
    assert got == [("ab", 0, 2), ("", 3, 3), ("é😀x", 4, 7)]
    view = one(spark, L.bounded_view(F.lit("aaaa\nbb\nccc"), 2, 3, 100))
    assert view == "1: aaa ... [truncated for prompt]\n2: bb\n3: ... [1 lines omitted for prompt]"
    assert one(spark, L.bounded_view(F.lit("aa\nbb"), 5, 9, 7)) == "1: aa\n2: ... [prompt view truncated at 7 chars]\n2: ... [1 lines omitted for prompt]"


def pack(sizes, budget):
    out, start = [], 0
    while start < len(sizes):
        used, end = sizes[start], start + 1
        while end < len(sizes) and used + 1 + sizes[end] <= budget:
            used += 1 + sizes[end]
            end += 1
        out.append((start, end))
        start = max(start + 1, end - 2)
    return out


def test_windows(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(1, 9) for _ in range(rng.randint(0, 15))]) for i in range(120)] + [(900, [1] * 5), (901, [1] * 8), (902, [50])]
    for budget in (5, 20, 100):
        df = spark.createDataFrame(rows, "id int, s array<int>").select("id", windows.greedy(F.col("s"), budget).alias("v"))
        got = {r.id: [(w.first, w.stop) for w in r.v] for r in df.collect()}
        assert got == {i: pack(s, budget) for i, s in rows}
    assert got[900] == [(0, 5), (3, 5), (4, 5)]
    short = one(spark, windows.greedy(F.array(*[F.lit(1)] * 5), 100, drop_redundant=True))
    assert [(w.first, w.stop) for w in short] == [(0, 5)]
    sizes = F.array(F.lit(2), F.lit(0), F.lit(7), F.lit(1))
    assert [(c.line, c.size) for c in one(spark, windows.chunks(sizes, 3))] == [(0, 2), (2, 3), (2, 3), (2, 1), (3, 1)]


def test_span_metrics_known_answers(spark):
    def m(a, b):
        arr = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
        return tuple(one(spark, v) for v in metrics.span_metrics(arr(a), arr(b)).values())

    assert m(["a"], ["a", "b"]) == (1.0, 0.5, 0.6667, 0.0)
    assert m([], []) == (1.0, 1.0, 1.0, 1.0) and m([], ["a"]) == (0.0, 0.0, 0.0, 0.0) and m(["b", "a", "a"], ["a", "b"])[3] == 1.0


def test_pair_metrics():
    assert metrics.fuzzy_counts(["ERROR: foo failed at line 12"], ["foo failed at line 12"]) == 1
    assert metrics.fuzzy_counts(["abc"], ["xyz"]) == 0 and metrics.line_overlap("", "a") == 0.0
    assert metrics.rouge_l("the cat sat", "the cat sat") == 1.0 and 0 < metrics.rouge_l("the cat", "the dog") < 1 and metrics.rouge_l("", "") == 0.0
    assert metrics.partial_cover([], []) == 1.0 and metrics.partial_cover(["a"], []) == 0.0 and metrics.partial_cover(["xabcx"], ["abc"]) == 1.0
    assert metrics.all_pairs_metrics([], []) == (1.0, 1.0, 1.0, 1.0, 0.0)
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics.lcs(a, b) == t[-1][-1]


def test_pruners_keep_a_tenth(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(30)) + "\nthe needle is here", "find NEEDLE"), (2, "", "x"), (3, "a\nb", "")], "id long, text string, query string")
    for name, f in rank.PRUNERS.items():
        got = {r.id: r.kept for r in f(df).collect()}
        assert [len(got[i]) for i in (1, 2, 3)] == [3, 1, 1], name
        assert all(x == sorted(x) for x in got.values())
    assert 31 in {r.id: r.kept for r in rank.bm25(df).collect()}[1]
    assert {r.id: r.kept for r in rank.bm25(df).collect()}[3] == [2]  # of equal scores the later line


PATCH = "diff --git a/x/m.py b/x/m.py\n--- a/x/m.py\n+++ b/x/m.py\n@@ -1,2 +3 @@ def foo\n+def foo():\n@@ -9,0 +10,0 @@\n@@ bad @@\ndiff --git a/y.py b/y.py\n+++ b/y.py\n@@ -1 +2,4 @@\n+class Bar:\ndiff --git a/gone b/gone\n+++ /dev/null\n"


def test_patch_parsing(spark):
    p = F.lit(PATCH)
    assert one(spark, patches.files(p)) == ["x/m.py", "y.py", "gone"]
    assert [tuple(h) for h in one(spark, patches.hunks(p))] == [("x/m.py", 3, 3), ("x/m.py", 10, 9), ("y.py", 2, 5)]
    assert one(spark, patches.names(p)) == ["Bar", "foo"]
    assert one(spark, calls.focus(p, F.lit("see `thing`"))) == "foo" and one(spark, calls.focus(F.lit(""), F.lit("see `thing`"))) == "thing"
    assert one(spark, calls.focus(F.lit(""), F.lit(""))) == calls.NO_FOCUS
    assert abs(sum(calls.WEIGHTS.values()) - 1) < 1e-9


def test_labels(spark):
    outputs = [
        (1, "i", "grep", "", "x/m.py:13: a\nx/m.py:30: b\nother.py:3: c\ngone:9: d\nnote"),
        (2, "i", "git_log", "", "fix FOO\nnothing"),
        (3, "i", "test_output", "", "ok\nFAIL: t\n trace\n---\n---\nx FAILED"),
        (4, "i", "git_diff", "", "diff --git a b\n+++ b/x\n+new\n ctx\n@@ 1"),
        (5, "i", "ls", "", "m.py\nz.py"),
        (6, "i", "lint_output", "", "y.py:1 bad\nnothing"),
        (7, "i", "curl", "", "x"),
        (8, "none", "grep", "", "x"),
        (9, "i", "read_file", "cat x/m.py", "1: import foo\n2: class A:\n3:     def g(self):\n4:         pass"),
        (10, "i", "read_file", "cat far.py", "1: import foo\n2: x"),
    ]
    df = spark.createDataFrame(outputs, "id int, instance_id string, tool_type string, command string, text string")
    got = {r.id: r.labels for r in patches.label(df, patches.patch_table(spark.createDataFrame([("i", PATCH)], "instance_id string, patch string"))).collect()}
    t, f = True, False
    assert got == {1: [t, f, f, t, f], 2: [t, f], 3: [f, t, t, t, f, t], 4: [t, f, t, f, t], 5: [t, f], 6: [t, f], 9: [t, t, t, f], 10: [f, f]}


def test_text_functions(spark):
    assert one(spark, X.squash(F.lit("  a\u00a0\n b\t"))) == "a b" and one(spark, X.words(F.lit(" "))) == []
    assert one(spark, X.tag(F.lit("x<t>\n a\nb \n</t><t>c</t>"), "t")) == "a\nb"
    assert one(spark, X.string_list(F.lit('["a", "b,c"]'))) == ["a", "b,c"] and one(spark, X.string_list(F.lit("a, b,"))) == ["a", "b"] and one(spark, X.string_list(F.lit(None).cast("string"))) == []
    assert one(spark, X.repo_of(F.lit("django__django-11099"))) == "django__django" and one(spark, X.repo_of(F.lit("plain"))) == "plain"
    assert one(spark, X.first_filled(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, X.salvage_json(F.lit('```json\n{"a": 1}\n```'), "a int")).a == 1 and one(spark, X.salvage_json(F.lit("so: {\"a\": 2} ok"), "a int")).a == 2
    assert one(spark, X.salvage_json(F.lit("none"), "a int")) is None
    assert [one(spark, f(F.lit("a/b.c/d.tar.gz"))) for f in (X.basename, X.stem, X.parent)] == ["d.tar.gz", "d.tar", "a/b.c"]
    assert one(spark, X.module_of(F.lit("a/b.py"))) == "a.b"


def test_prompts_and_replies(spark):
    p = one(spark, dataset.prompt(F.lit("q" * 1200), F.lit("out\nput"), F.lit(None).cast("string")))
    assert "q" * 1000 + "...\n</query>" in p and "background_task" not in p
    parts = dataset.parse_prompt(F.lit(p))
    assert one(spark, parts["output"]) == "out\nput"
    assert one(spark, dataset.parse_prompt(F.lit("<task>\nt\n</task>"))["query"]) == "t"
    m = one(spark, dataset.messages(F.lit("x" * 5000), F.lit("o")))
    assert len(re.search(r"<query>\n(.*?)\n", m[1].content).group(1)) == 3003 and "<query>" not in one(spark, dataset.messages(F.lit(""), F.lit("o")))[1].content
    parse = lambda s: one(spark, dataset.parse_lines(F.lit(s)))
    assert parse('{"relevant_lines": ["a", "b"]}') == ["a", "b"] and parse('{"relevant_lines": []}') == [] and parse('{"other": 1}') == []
    assert parse("<relevant_lines>\n a \n\nb\n</relevant_lines>") == ["a", "b"] and parse(" raw \n\nx") == ["raw", "x"]


def test_audit_and_compatibility(spark):
    ok = lambda tool, q: one(spark, audit.compatible(F.lit(tool), F.lit(q)))
    assert ok("grep", "Find the hits") and not ok("grep", " ") and not ok("ls", "show the traceback") and not ok("grep", "Find the import statement of x") and ok("read_file", "find the import statement")
    assert not ok("python", "the code block of class A")
    assert one(spark, audit.in_order(F.lit("a\nb\nc"), F.array(F.lit("a"), F.lit("c")))) and not one(spark, audit.in_order(F.lit("a\nb\nc"), F.array(F.lit("c"), F.lit("a"))))


def test_scoring_hooks(spark):
    df = spark.createDataFrame([(1, "alpha beta\nx\nalpha", "alpha beta"), (2, None, None)], "id int, text string, query string")
    assert {r.id: r.kept_text for r in scoring.extract_many(df).collect()} == {1: "alpha beta\nalpha", 2: ""}
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, scoring.model_input(ids(5), F.array(ids(6, 7), ids(8)), 1, 2, 3, 99)) == [1, 5, 2, 6, 7, 3, 8, 2]
    assert one(spark, scoring.masked_labels(ids(1, 2, 3), ids(7, 8))) == [-100] * 3 + [7, 8]
    assert one(spark, scoring.padded(ids(1, 2), F.lit(4), 0, True)) == [0, 0, 1, 2] and one(spark, scoring.padded(ids(1), F.lit(2), -100, False)) == [1, -100]
    assert one(spark, scoring.class_weight(F.lit(2), F.lit(100))) == 10.0 and one(spark, scoring.class_weight(F.lit(0), F.lit(5))) is None
    w = spark.createDataFrame([(str(i), i % 10 == 0) for i in range(500)], "key string, positive boolean")
    got = scoring.balanced(w, 0.5).groupBy("positive").count().collect()
    assert {r.positive: r["count"] for r in got} == {True: 50, False: 50}


def test_ranked_is_the_global_order(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int")
    got = ranked(df, F.col("v")).collect()
    assert all(r.v == r["rank"] for r in got) and len(got) == 1000
    assert ranked(df.limit(0), F.col("v")).count() == 0


def test_session_times(spark):
    for t, micros in [("2025-01-01T00:00:01Z", 1_000_000), ("2025-01-01 00:00:01", 1_000_000), ("2025-01-01T01:00:01.5+01:00", 1_500_000)]:
        assert one(spark, F.unix_micros(sessions.instant(F.lit(t)))) == 1735689600_000_000 + micros
    assert one(spark, sessions.instant(F.lit("no time"))) is None


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id int, t string")
    T.write_jsonl(df, f"{tmp_path}/x")
    T.write_jsonl(df, f"{tmp_path}/x", append=True)
    assert T.read_jsonl(spark, f"{tmp_path}/x", "id int, t string").count() == 4
    (tmp_path / "d.json").write_text('[{"id": 1},\n {"id": 2}]')
    assert T.read_json(spark, f"{tmp_path}/d.json", "id int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": ')
    with pytest.raises(Exception):
        T.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "id int").collect()
    (tmp_path / "t.txt").write_text("a\nb\n")
    assert T.read_texts(spark, f"{tmp_path}/t.txt").first().text == "a\nb\n"
    made = []
    for _ in range(2):
        assert T.stage(spark, f"{tmp_path}/stage", lambda: made.append(1) or df).count() == 2
    assert made == [1]
    assert T.unfinished(df, df.where("id = 2"), ["id", "t"]).collect()[0].id == 1
    assert T.write_report(df.limit(1), f"{tmp_path}/r/report.json") == {"id": 1, "t": "a\nb"}
    assert T.markdown(df.select("id")).split("\n") == ["| id |", "| --- |", "| 1 |", "| 2 |"]
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert T.config(["/no/such.json", f"{tmp_path}/c.json"]) == {"a": 1} and T.first_setting(None, "", "x") == "x"


def test_streams_equal_batches(spark, sf, tmp_path):
    from lineloom.streaming import log

    src = tmp_path / "in"
    rows = spark.read.parquet(f"{sf}/session_log.parquet")
    rows.repartition(3).write.parquet(str(src))
    stream = log.savings(log.source(spark, str(src), rows.schema, files_per_batch=1), late="3650 days")
    q = stream.writeStream.format("memory").queryName("savings").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sessions.deliveries(rows).withColumn("at", sessions.instant(F.col("ts"))).groupBy(F.date_trunc("day", "at").alias("start")).agg(F.count("*").alias("runs"))
    assert {tuple(r) for r in spark.table("savings").select("start", "runs").collect()} == {tuple(r) for r in want.collect()}
    obs = spark.createDataFrame([(i, f"a\nneedle {i}\nb", "needle") for i in range(5)], "id long, text string, query string")
    obs.write.parquet(f"{tmp_path}/obs")
    log.run(log.prune(log.source(spark, f"{tmp_path}/obs", obs.schema)), f"{tmp_path}/out", f"{tmp_path}/ck2").awaitTermination()
    assert {r.kept_text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {f"needle {i}" for i in range(5)}


def test_bm25_equals_the_plain_formula():
    rng = random.Random(3)
    for _ in range(50):
        lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 40))]
        query = " ".join(rng.choice("abcxyz") for _ in range(3))
        docs, terms = [x.split() for x in lines], sorted(set(query.split()))
        n, avg = len(docs), max(sum(map(len, docs)) / len(docs), 1)
        idf = {t: math.log((n - (d := sum(t in x for x in docs)) + 0.5) / (d + 0.5) + 1) for t in terms}
        score = [round(sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in terms if t in x), 9) for x in docs]
        want = sorted(i + 1 for _, i in sorted(((s, i) for i, s in enumerate(score)), reverse=True)[: max(1, n // 10)])
        assert rank.bm25_lines("\n".join(lines), query, 1.5, 0.75) == want
    assert rank.bm25_lines("", "", 1.5, 0.75) == [1]


def test_pruners_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a\nb", None), (3, "", ""), (4, "x\na b\ny", "B a")], "id int, text string, query string")
    got = {r.id: r.kept for r in rank.bm25(df).collect()}
    assert got == {1: None, 2: None, 3: [1], 4: [2]} and rank.bm25(df.limit(0)).count() == 0


def test_lines_match_either_way():
    assert rank.matching_lines(["a  b", "x", "", "b", "a b c", "q"], ["a b", " ", "zz"]) == [1, 4, 5]
    assert rank.matching_lines(["a"], []) == []


def test_fuzzy_counts_equal_all_pairs():
    rng = random.Random(5)

    def plain(pred, ref):
        pairs = sorted(((metrics.line_overlap(a, b), i, j) for i, a in enumerate(pred) for j, b in enumerate(ref)), reverse=True)
        used_a, used_b = set(), set()
        for s, i, j in pairs:
            if s >= 0.5 and i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
        return len(used_a)

    word = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))
    for _ in range(300):
        a, b = [word() for _ in range(rng.randint(0, 7))], [word() for _ in range(rng.randint(0, 7))]
        assert metrics.fuzzy_counts(a, b) == plain(a, b)


def test_bundle_counts_errors_and_measures_the_rest(spark):
    rows = [(1, "a\nb", ["a"], ["a"], None), (2, "a\nb", [], ["a"], ""), (3, "a", ["a"], ["a"], "timed out")]
    got = {r.metric: r for r in metrics.bundle(spark.createDataFrame(rows, "id int, text string, pred array<string>, ref array<string>, error string"), "id").collect()}
    assert set(got) == set(metrics.MEASURES) and len(got) == 11
    assert all((r.n, r.n_samples, r.n_errors) == (2, 3, 1) for r in got.values())
    assert got["recall"].mean == 0.5 and got["fuzzy_f1"].mean == 0.5 and got["compression"].mean == 0.5


def enclosing_plain(content, targets):
    out = set()
    depth = lambda x: len(x) - len(x.lstrip())
    for t in targets:
        level = depth(content[t - 1])
        for i in range(t - 1, 0, -1):
            x = content[i - 1]
            if x.lstrip().startswith(("def ", "class ")) and depth(x) < level:
                out.add(i)
                level = depth(x)
    return out


def test_enclosing_definitions_equal_walking_up():
    rng = random.Random(7)
    for _ in range(300):
        content = [" " * rng.choice((0, 0, 2, 4, 6)) + rng.choice(("def f():", "class A:", "x = 1", "", "return")) for _ in range(rng.randint(1, 25))]
        targets = [i + 1 for i in range(len(content)) if rng.random() < 0.3]
        assert patches.enclosing(content, targets) == enclosing_plain(content, targets)


def test_running_sums(spark):
    df = spark.createDataFrame([(1, [3, 1, 2]), (2, []), (3, None)], "id int, a array<int>")
    got = {r.id: r.v for r in df.select("id", arrays.cumulative(F.col("a")).alias("v")).collect()}
    assert got == {1: [0, 3, 4, 6], 2: [0], 3: [0]}
    assert df.where("id = 1").select(arrays.first_within(arrays.cumulative(F.col("a")), F.lit(2)).alias("v")).first().v == [0, 0, 0, 2]


def test_gates(spark):
    text = "\n".join(f"line {i}" for i in range(1, 11)) + "\n "
    rows = [(1, "a long query", text, [3, 1, 3, 99, 11]), (2, "short", text, [1]), (3, "a long query", "a\nb", [1]), (4, "a long query", text, list(range(1, 8))), (5, "a long query", text, [0, 11]), (6, "a long query", None, None)]
    df = spark.createDataFrame(rows, "id int, query string, tool_output string, picked array<int>")
    assert [(r.id, r.numbers) for r in gates.generated(df, F.col("picked")).collect()] == [(1, [1, 3])]
    spans = spark.createDataFrame([(1, "swe", [(1, 1)]), (2, "swe", []), (3, "synthetic_negative", None), (4, None, None)], f"id int, source string, gold_spans {SPANS}")
    assert {r.id for r in gates.with_evidence(spans).collect()} == {1, 3}
    d = spark.createDataFrame([(1, "a\nb\nc\nd", [(2, 2)]), (2, "a\nb", [(1, 1)]), (3, "a\n \nc", [(2, 2)]), (4, "a", None)], f"id int, tool_output string, gold_spans {SPANS}")
    assert {r.id: (r.distilled_lines, r.kept_lines) for r in gates.distilled(d).collect()} == {1: (3, 1), 2: (2, 1), 3: (3, 1)}


def test_unknown_tools_raise(spark):
    configs = spark.createDataFrame([("grep",), ("ls",)], "tool_type string")
    assert gates.pick_tools(configs, []).count() == 2 and gates.pick_tools(configs, ["ls"]).count() == 1
    with pytest.raises(ValueError, match="nope"):
        gates.pick_tools(configs, ["ls", "nope"])


def test_review_filters_and_orders(spark):
    rows = [(1, 0.2, 0.0, 0.9, "true_positive", ["r"], None, "Find IT"), (2, None, 1.0, None, "false_negative", [], "boom", None)]
    df = spark.createDataFrame(rows, "id int, f1 double, exact_match double, fuzzy_f1 double, category string, ref array<string>, error string, task string")
    got = {k: [r.id for r in df.where(v).orderBy("id").collect()] for k, v in gates.review_modes().items()}
    assert got == {"all": [1, 2], "errors": [2], "bad_exact": [1], "bad_fuzzy": [2], "false_negative": [2], "false_positive": [], "empty_gold": [2], "nonempty_gold": [1]}
    assert [r.id for r in df.orderBy(*gates.review_order("lowest_f1", "id")).collect()] == [2, 1] and [r.id for r in df.orderBy(*gates.review_order("highest_f1", "id")).collect()] == [1, 2]
    wide = df.withColumns({c: F.lit(None).cast("string") for c in ("tool_output", "prompt")}).withColumn("pred", F.array(F.lit("x")))
    assert [r.id for r in wide.where(gates.review_search("find it")).collect()] == [1] and wide.where(gates.review_search("BOOM")).count() == 1


def test_extract_many_keeps_rows_of_one_id_apart(spark):
    df = spark.createDataFrame([(1, "find me\nno", "find"), (1, "other\nfind", "find"), (2, None, None)], "id int, text string, query string")
    assert sorted(map(tuple, scoring.extract_many(df).collect())) == [(1, "find"), (1, "find me"), (2, "")]


def test_read_targets_and_source_plan(spark):
    patch = lambda *fs: "\n".join(f"diff --git a/{f} b/{f}\n--- a/{f}\n+++ b/{f}" for f in fs)
    instances = spark.createDataFrame([("i1", patch("a/x.py", "b/y.py")), ("i2", ""), ("i3", patch("a/x.py")), ("i4", None)], "instance_id string, patch string")
    files = spark.createDataFrame([("i1", f) for f in ("a/x.py", "c/z.py", *(f"a/s{k}.py" for k in range(9)))] + [("i2", "q.py")], "instance_id string, file string")
    got = {r.instance_id: (r.target, r.is_patch_file) for r in calls.read_targets(instances, files).collect()}
    assert got["i2"] == ("q.py", False) and got["i3"] == ("a/x.py", True) and "i4" not in got
    assert got["i1"][0] in {"a/x.py", "b/y.py"} if got["i1"][1] else got["i1"][0].startswith("a/s")
    plan = {(r.file, r.kind) for r in calls.source_plan(instances, files).where("instance_id = 'i1'").collect()}
    assert plan == {("a/x.py", "patch"), ("b/y.py", "patch"), *((f"a/s{k}.py", "sibling") for k in range(6))}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, named = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.named

        def setCheckpointDir(self, path):
            self.named = path

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert runtime.checkpoint_dir(Session()) == Session.sparkContext.named


def test_head_by_hash_has_the_first_rows(spark):
    df = spark.range(5000).withColumn("h", F.md5(F.col("id").cast("string")))
    want = {r.id for r in df.orderBy("h").limit(300).collect()}
    got = {r.id for r in runtime.head_by_hash(df, "h", 300).collect()}
    assert want <= got and len(got) < 320 and runtime.head_by_hash(df, "h", 9999).count() == 5000


def test_segments_and_their_pools(spark):
    df = spark.createDataFrame([(1, [7, 8, -1, 9, -1, -1, 5], [0.1, 0.4, 9.0, 0.2, 9.0, 9.0, 0.3]), (2, [], []), (3, None, None)], "id int, tokens array<int>, scores array<double>")
    got = {(r.id, r.segment): (r.best, r.mean) for r in scoring.pooled_segments(df, -1).collect()}
    assert got == {(1, 0): (0.4, 0.25), (1, 1): (0.2, 0.2), (1, 3): (0.3, 0.3)}


def test_blank_lines_raise_where_they_must(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n\n{"x": 2}\n')
    path = str(tmp_path / "a.json")
    assert sorted(r.x for r in T.read_jsonl(spark, path, "x int").collect()) == [1, 2]
    with pytest.raises(ValueError, match="blank"):
        T.read_jsonl(spark, path, "x int", blanks=False)


def test_command_line(spark, tmp_path, capsys, sf):
    from lineloom import __main__ as cli

    a = cli.parse(["why it fails", "log.txt"])
    assert (a.command, a.query, a.file, a.pruner) == ("extract", "why it fails", "log.txt", "bm25")
    assert cli.parse(["run", "first_n", "in", "out"]).name == "first_n"
    assert cli.extract(spark, "needle", "hay\nneedle here\nhay") == "needle here"
    (tmp_path / "t.txt").write_text("one\ntwo needle")
    assert cli.main(["extract", "needle", str(tmp_path / "t.txt")]) == 0 and capsys.readouterr().out == "two needle\n"
    assert cli.main(["run", "all_any", sf, str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert cli.main(["run", "nothing", sf, str(tmp_path / "x")]) == 2


def test_line_examples_leave_empty_windows_out(spark):
    df = spark.createDataFrame([(1, [5], [[10, 11], [], [12], [], []], [1, 0, 0, 0, 0]), (2, [5], [[], []], [0, 0]), (3, [5], [], [])], "id int, task array<int>, lines array<array<int>>, labels array<int>")
    got = {(r.id, r.window): (r.input_ids, r.attention, r.line_labels) for r in scoring.line_examples(df, 1, 2, 3, 9, 4).collect()}
    assert all(k[0] == 1 for k in got)
    ids, mask, labels = got[1, 0]
    assert ids[:4] == [1, 5, 2, 10] and len(ids) <= 9 and mask == [1] * len(ids) and labels[0] == 1
    assert all(any(t in r[0] for t in (10, 11, 12)) for r in got.values())


def test_highlighter_spans_touch_lines(spark):
    df = spark.createDataFrame([(1, "ab\n\ncd ef\ngh", "x"), (2, None, None)], "id int, text string, query string")
    hook = lambda spans: lambda: lambda q, t: spans
    lines = lambda *spans: [r.line_no for r in scoring.highlighted(df.where("id = 1"), hook(list(spans))).orderBy("line_no").collect()]
    assert lines((0, 1)) == [1] and lines((2, 4)) == [] and lines((1, 5)) == [1, 3] and lines((9, 12)) == [4] and lines((3, 3)) == []
    assert scoring.highlighted(df).count() == 0


def test_warnings_of_a_dataset(spark):
    schema = "prompt string, response string, compression_ratio double, tool_type string, is_eval boolean"
    got = lambda rows: {r.warning: r.value for r in gates.warnings(spark.createDataFrame(rows, schema)).collect()}
    assert got([]) == {"no_samples": 0.0}
    assert got([("p" * 50_001, " ", 0.2, "grep", True)]) == {"mean_ratio_low": 0.2, "missing_tools": 4.0, "few_eval_samples": 1.0, "long_prompts": 1.0, "empty_responses": 1.0}
    assert got([("p", "r", 0.9, t, True) for t in gates.EXPECTED for _ in range(2)]) == {}


def test_softmax_does_not_overflow(spark):
    got = one(spark, scoring.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(0.0))))
    assert got == [0.5, 0.5, 0.0]
