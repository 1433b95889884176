"""Texts cut off by field limits or in mid-transfer (problem 1).

Two kinds of evidence are added on the log-odds scale.

*Length.* Per source, text lengths follow a log-normal distribution that is right-censored at field limits: a text
longer than a limit is seen at the limit. Candidate limits are lengths at which the number of different texts stands far
above that of their neighbours; a short text that is frequent is no limit. An EM iteration over one length for each
text (in characters, without a mark put after a cut) gives the maximum-likelihood location and scale, the number of
censored values at each limit, and so the posterior that a value at this limit was censored and not there by the
fitted density. A row is held against it with its lengths in characters and bytes, with and without the mark.

*Ending.* A logistic model tells a whole line from one that stops inside. It needs no labels: whole lines are lines
from inside the texts and last lines of texts whose length is at no limit; stopped ones are inner lines cut at a
uniformly drawn character, some with what is usually put after a cut. It is fitted on a bounded sample
(about ``SAMPLE_ROWS`` rows chosen by a hash of their ids, ``SAMPLE_LINES`` lines of each) and scores the last line of
every row. Two models of half the sample's rows each score the other half: last lines that look stopped to the model that
hasn't seen them are no examples of whole ones, and as overlapping features make scores too sure, their scale and offset
are fitted on these scores. The final model is trained on what is left.

Null and empty texts, and texts of white space only, are never cut. Length statistics and limits are those of all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stable

SAMPLE_ROWS = 8_000
SAMPLE_LINES = 8
#: One of so many examples of inner lines is used to calibrate.
CALIBRATE = 4
DIM = 1 << 18
EPOCHS = 6
#: Share of rows cut at a length that is no limit (mid-transfer) that the prior assumes.
ELSEWHERE = 0.03
#: The same where the text ends in a message that a transfer ended early.
AFTER_NOTE = 0.9
#: A limit's count is at least this, and this many standard deviations above its neighbours.
SPIKE_ROWS, SPIKE_SIGMAS, NEIGHBOURS = 5, 5.0, 40

#: What is put directly after a cut.
MARKS = ("...", "…", "�")
#: Messages on a line of their own after a text that was shortened or broke off.
OMITTED = re.compile(r"^\W*\(?(?:\d+ )?(?:more )?(?:lines?|rows?|characters?|chars|bytes)?\W*(?:\d+ )?(?:more )?(?:lines?|rows?|chars|characters|bytes)?\s*(?:omitted|truncated|elided|skipped|not shown|hidden)\W*$", re.I)
BROKEN = re.compile(r"\b(?:aborted|closed|reset|interrupted|hung up|timed out|broken pipe|broke off|disconnected|terminated|lost|dropped|truncated|cut off|cut short|incomplete|unexpected end|unexpected eof|stopped early|stream ended|eof)\b", re.I)

#: What a note is put in, or curl's error number before it.
_FRAME = re.compile(r"^(?:curl: \(\d+\) |[\s<>\[\](){}*#=.\-]+)|[\s<>\[\](){}*#=.\-]+$", re.I)
_FRAMED = re.compile(r"^(?:<.*>|\[.*\]|\(.*\)|\*+.*\*+|-{2,}.*-{2,}|={2,}.*={2,})$")
#: What breaks off: a note that begins with it may hold a number.
_SUBJECT = re.compile(r"^(?:the )?(?:connection|transfer|stream|pipe|peer|socket|download|upload|session|remote|network|transmission)\b", re.I)
_CODE = re.compile(r"[_/=<>{}\[\]`'\"#]")

_ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|\s+|[^\sA-Za-z\d]|\w")
_RUNS = re.compile(r"[A-Za-z][a-z]*")


def _kind(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "9"
    if c.isspace():
        return " "
    if c.isalpha():
        return ("A" if c.isupper() else "a") if c.isascii() else "x"
    return c


def line_features(tool: str, line: str, known: dict) -> list[int]:
    """Hashed features of the end of a line, of its frame and of open brackets and quotes."""
    tokens = _TOKEN.findall(line)
    shape = [_kind(t) for t in tokens]
    kinds = []
    for k in shape:
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    skeleton = "".join(kinds)
    last = tokens[-1] if tokens else ""
    word = last.lower() if last[:1].isalpha() else ""
    before = tokens[-2] if len(tokens) > 1 else ""
    seen = known.get(word, 0) if word else -1
    seen = "no" if seen < 0 else "new" if seen < 2 else "rare" if seen < 6 else "usual"
    lead = "".join(shape[:3])
    first = next((t.lower() for t in tokens if not t.isspace()), "")
    opened = sum(line.count(a) - line.count(b) for a, b in ("()", "[]", "{}", "<>"))
    opened = max(-2, min(3, opened))
    quotes = "".join(str(line.count(q) % 2) for q in "'\"`")
    tail = "".join(shape[-5:])
    f = [
        f"t1{shape[-1:]}", f"t2{''.join(shape[-2:])}", f"t3{''.join(shape[-3:])}", f"t5{tail}", f"t8{''.join(shape[-8:])}",
        f"w{word}", f"w2{before}{last}", f"l3{line[-3:]}", f"l5{line[-5:]}", f"s{seen}", f"sb{seen}{before[:1]}",
        f"o{opened}", f"q{quotes}", f"oq{opened}{quotes}{shape[-1:]}", f"k{skeleton[-12:]}", f"h{lead}", f"f{first}|{tail[-3:]}",
        f"fs{first}|{seen}", f"n{min(len(tokens), 12)}|{tail[-2:]}", f"fn{first}|{min(len(tokens), 30)}",
        f"kk{skeleton}" if len(skeleton) <= 40 else f"kl{skeleton[-30:]}", f"hk{lead}|{tail}", f"so{seen}{opened}{quotes}",
    ]
    plain = 0
    for w in reversed(line.split(" ")):
        if not w.isalpha() or not w.islower():
            break
        plain += 1
    plain = min(plain, 4) if plain < 5 else 5 if plain < 9 else 6
    words = line.split()
    prose = min(sum(w.isalpha() and w.islower() for w in words[-14:]), 12) // 3
    f += [
        f"p{plain}|{shape[-1:]}", f"pp{prose}|{shape[-1:]}", f"ps{prose}|{plain}|{seen}", f"pf{first}|{plain}|{prose}|{shape[-1:]}", f"fo{first}|{opened}|{quotes}|{shape[-1:]}",
        f"nw{min(len(words), 25)}|{first}|{shape[-1:]}", f"l4{line[-4:]}", f"lw{words[-1][:24] if words else ''}", f"lk{''.join(_kind(t) for t in _TOKEN.findall(words[-1])) if words else ''}|{len(words) > 1}",
        f"e{line[-1:]}|{opened}|{plain > 0}|{prose}",
    ]
    f += [f"{tool}|{x}" for x in (f[0], f[1], f[2], f[5], f[9], f[14], f[16], f[20], f[23], f[24], f[26], f[28], f[31], f[32])]
    return [xxhash.xxh3_64_intdigest(x) % DIM for x in f]


def broken_note(line: str) -> str:
    """'broken' if a line is a message that a transfer broke off, 'maybe' if it may be one, else ''."""
    short = line.strip()
    if len(short) >= 120 or not BROKEN.search(short):
        return ""
    inner = _FRAME.sub("", short)
    sure = len(inner) < 60 and not _CODE.search(inner) and (_FRAMED.match(short) or _SUBJECT.match(inner) or not re.search(r"\d", inner))
    return "broken" if sure else "maybe"


def _body(text: str) -> str:
    """A whole text without colour codes and the white space at its end."""
    return (re.sub(_ANSI, "", text) if "\x1b" in text else text).rstrip()


def final_line(text: str) -> tuple[str, str]:
    """(last line that is no message, kind of message after it: '', 'omitted' or 'broken'), without colour codes."""
    head, _, line = _body(text).rpartition("\n")
    note = ""
    for _ in range(2):
        short = line.strip()
        if head.strip() and ((len(short) < 120 and OMITTED.match(short)) or (not note and broken_note(short) == "broken")):
            note = "omitted" if OMITTED.match(short) else "broken"
            head, _, line = head.rstrip().rpartition("\n")
        else:
            break
    return line, note


def line_before(text: str, line: str, note: str) -> str:
    """The line before the last one where that may be a message that a transfer broke off, else ''."""
    if note or broken_note(line) != "maybe":
        return ""
    return final_line(_body(text).rpartition("\n")[0])[0]


class EndingModel:
    """Logistic model over hashed line features, with the words its sample knows."""

    def __init__(self, weights: np.ndarray, bias: float, known: dict, scale: float = 1.0, offset: float = 0.0):
        self.weights, self.bias, self.known, self.scale, self.offset = weights, bias, known, scale, offset

    def score(self, tool: str, line: str) -> float:
        """Log-odds that ``line`` stops inside, for even prior odds."""
        return self.scale * float(self.weights[line_features(tool, line, self.known)].sum() + self.bias) + self.offset


def cut_example(line: str, rng: np.random.Generator) -> str | None:
    if len(line.strip()) < 4:
        return None
    at = int(rng.integers(max(1, len(line) - len(line.lstrip()) + 1), len(line)))
    stem = line[:at].rstrip() if rng.random() < 0.9 else line[:at]
    u = rng.random()
    return (stem + (MARKS[0] if u < 0.15 else MARKS[1] if u < 0.27 else MARKS[2] if u < 0.35 else "")) if stem.strip() else None


def calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(scale, offset) at which ``scale * z + offset`` is nearest to the log-odds of ``y``: least log-loss on a grid.

    Scores are never made surer than they are, and of equally good offsets the smallest is taken.
    """
    best = (math.inf, 1.0, 0.0)
    for scale in np.linspace(0.1, 1.0, 19):
        for offset in np.linspace(-4, 4, 33):
            t = (scale * z + offset) * (1 - 2 * y)
            loss = float((weight * np.logaddexp(0, t)).sum() / weight.sum() + 1e-4 * offset * offset)
            best = min(best, (loss, float(scale), float(offset)))
    return best[1:]


def examples(lines: pd.DataFrame, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]:
    """(features, stopped, weight, row, is a last line, known words) of whole lines and of inner ones cut to make the other class.

    A word counts as known only by its other occurrences, and by none at the end of a last line.
    """
    known = Counter()
    for line, is_last in zip(lines.line, lines.is_last):
        words = [w.lower() for w in _RUNS.findall(line)]
        known.update(words[:-1] if is_last else words)
    x, y, weight, row, last = [], [], [], [], []

    def add(features: list[int], kind: int, w: float, r: int, is_last: bool) -> None:
        x.append(np.array(features, np.int32))
        for a, v in ((y, kind), (weight, w), (row, r), (last, is_last)):
            a.append(v)

    for r, tool, line, is_last in zip(lines.row, lines.tool, lines.line, lines.is_last):
        own = _TOKEN.findall(line)
        w = own[-1].lower() if own and own[-1][:1].isalpha() else ""
        held = not is_last and w in known
        if held:
            known[w] -= 1
        add(line_features(tool, line, known), 0, 2.0 if is_last else 1.0, r, is_last)
        if held:
            known[w] += 1
        if not is_last:
            for _ in range(1 + (len(line) > 60)):
                if (c := cut_example(line, rng)) is not None:
                    add(line_features(tool, c, known), 1, 1.0, r, False)
    return np.array(x), np.array(y, np.float32), np.array(weight, np.float32), np.array(row, np.int64), np.array(last, bool), dict(known)


def descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic model over hashed features, by adaptive gradient steps."""
    wt = weight.copy()
    wt[y == 1] *= wt[y == 0].sum() / max(1.0, wt[y == 1].sum())
    w, g2, bias = np.zeros(DIM, np.float32), np.full(DIM, 1e-2, np.float32), 0.0
    order = np.arange(len(y))
    for _ in range(EPOCHS):
        rng.shuffle(order)
        w *= 0.98
        for i in range(0, len(order), 512):
            at = order[i : i + 512]
            z = w[x[at]].sum(axis=1) + bias
            g = (1 / (1 + np.exp(-z)) - y[at]) * wt[at]
            ids = x[at].ravel()
            gs = np.repeat(g, x.shape[1])
            np.add.at(g2, ids, gs * gs)
            np.add.at(w, ids, -0.12 * gs / np.sqrt(g2[ids]))
            bias -= 0.01 * float(g.mean())
    return w, bias


def fit_ending(lines: pd.DataFrame, seed: int = 7) -> EndingModel:
    """lines: row, tool, line, is_last. Features are made once; the models of the halves and the final one share them."""
    rng = np.random.default_rng(seed)
    x, y, weight, row, last, known = examples(lines, rng)
    if not len(y):
        return EndingModel(np.zeros(DIM, np.float32), 0.0, {})
    z = np.zeros(len(y))
    for part in (0, 1):
        there = row % 2 == part
        w, bias = descend(x[~there], y[~there], weight[~there], rng)
        z[there] = w[x[there]].sum(axis=1) + bias
    scale, offset = 1.0, 0.0
    some = np.flatnonzero(last | (np.arange(len(y)) % CALIBRATE == 0))
    if len(some) >= 50 and 0 < y[some].sum() < len(some):
        scale, offset = calibration(z[some], y[some], np.where(y[some] == 1, (len(some) - y[some].sum()) / y[some].sum(), 1.0))
    keep = ~(last & (scale * z + offset > 0))
    w, bias = descend(x[keep], y[keep], weight[keep], rng)
    return EndingModel(w, bias, {k: min(v, 6) for k, v in known.items()}, scale, offset)


def _base(text: Column) -> Column:
    """Without what is put directly after a cut, and white space after that."""
    return F.regexp_replace(F.regexp_replace(text, _ANSI + r"$", ""), r"(?:\.\.\.|…|\x{FFFD})?\s*$", "")


def lengths(rows: DataFrame) -> DataFrame:
    """source, n (characters without a mark after a cut), nbytes, and key of each different text of a source."""
    base = F.length(F.regexp_replace("text", r"(?:\.\.\.|…|\x{FFFD})\s*$", ""))
    return rows.select("source", F.xxhash64("text").alias("key"), base.alias("n"), F.octet_length("text").alias("nbytes")).distinct()


def candidate_limits(sizes: DataFrame) -> DataFrame:
    """source, size, rows: lengths of far more different texts than their neighbours have. sizes: source, size, one row a text."""
    hist = sizes.groupBy("source", "size").agg(F.count("*").alias("rows"))
    bins = hist.groupBy("source", F.floor(F.col("size") / NEIGHBOURS).alias("bin")).agg(F.sum("rows").alias("all"))
    at = hist.where(f"rows >= {SPIKE_ROWS}").withColumn("bin", F.explode(F.expr(f"sequence(cast(floor(size / {NEIGHBOURS}) as bigint) - 1, cast(floor(size / {NEIGHBOURS}) as bigint) + 1)")))
    near = at.join(bins, ["source", "bin"], "left").groupBy("source", "size", "rows").agg(F.sum(F.coalesce(F.col("all"), F.lit(0))).alias("around"))
    near = near.withColumn("near", (F.col("around") - F.col("rows")) / (3.0 * NEIGHBOURS))
    return near.where(F.expr(f"size > 0 and rows > 3 * near and (rows - near) / sqrt(near + 1) >= {SPIKE_SIGMAS}")).select("source", "size", "rows")


def _tail(mu: float, sd: float, size: float) -> tuple[float, float, float]:
    """Survival, mean and mean square of log length beyond ``size``."""
    z = (math.log(size) - mu) / sd
    s = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
    r = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / s
    return s, mu + sd * r, sd * sd * (1 + z * r) + mu * mu + 2 * mu * sd * r


def fit_censored(n: float, s1: float, s2: float, limits: list[tuple[float, float]], rounds: int = 200) -> tuple[float, float, dict]:
    """(mu, sigma, {limit: posterior}) of a log-normal right-censored at ``limits`` (size, rows).

    n, s1 and s2 are the number of all values, and the sums of their log and squared log lengths.
    """
    if n < 2:
        return 0.0, 1.0, {size: 0.0 for size, _ in limits}
    mu, sd = s1 / n, math.sqrt(max(s2 / n - (s1 / n) ** 2, 1e-4))
    post = {}
    for _ in range(rounds):
        m1, m2 = s1, s2
        for size, rows in limits:
            natural = n * math.exp(-((math.log(size) - mu) ** 2) / (2 * sd * sd)) / (size * sd * math.sqrt(2 * math.pi))
            post[size] = min(1 - 1e-3, max(1e-3, 1 - natural / rows))
            c = post[size] * rows
            _, e1, e2 = _tail(mu, sd, size)
            m1 += c * (e1 - math.log(size))
            m2 += c * (e2 - math.log(size) ** 2)
        new = m1 / n, math.sqrt(max(m2 / n - (m1 / n) ** 2, 1e-4))
        done = abs(new[0] - mu) + abs(new[1] - sd) < 1e-7
        mu, sd = new
        if done:
            break
    return mu, sd, post


def length_model(texts: DataFrame) -> tuple[dict, list[tuple]]:
    """{source: (mu, sigma, texts)} and (source, limit, texts there, posterior) of every candidate limit; texts as of :func:`lengths`.

    Limits are looked for among lengths in characters and in bytes; the fit is over one length a text. What comes to the
    driver are a row a source, and its limits.
    """
    limits = candidate_limits(texts.select("source", F.explode(F.array_distinct(F.array("n", "nbytes"))).alias("size"))).collect()
    stats = texts.where("n > 0").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.log("n")).alias("s1"), F.sum(F.pow(F.log("n"), 2)).alias("s2")).collect()
    fits, found = {}, []
    for r in stats:
        own = [(float(x.size), float(x.rows)) for x in limits if x.source == r.source]
        mu, sd, post = fit_censored(float(r.n), float(r.s1), float(r.s2), own)
        fits[r.source] = (mu, sd, int(r.n))
        found += [(r.source, int(size), int(rows), float(post[size])) for size, rows in own]
    return fits, found


def _sample_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row, tool, text, plain in zip(pdf.row, pdf.tool, pdf.text, pdf.plain):
            lines = [x.rstrip() for x in re.sub(_ANSI, "", text).rstrip().split("\n")]
            inner = [x for x in lines[:-1] if x.strip()]
            if inner:
                rng = np.random.default_rng(xxhash.xxh3_64_intdigest(text[:2000].encode("utf-8", "replace")))
                pick = rng.choice(len(inner), min(SAMPLE_LINES, len(inner)), replace=False)
                out += [(row, tool, inner[i], False) for i in pick]
            if plain:
                line, note = final_line(text)
                if line.strip() and not note:
                    out.append((row, tool, line, True))
        yield pd.DataFrame(out, columns=["row", "tool", "line", "is_last"])


def cut_rows(df: DataFrame, id_col: str = "sample_id", text_col: str = "tool_output", source_col: str = "source", tool_col: str = "tool_type") -> tuple[DataFrame, list[tuple]]:
    """((id, source, log_odds, posterior) of every row, limits as of :func:`length_model`)."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(tool_col), F.lit("")).alias("tool"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fits, limits = length_model(stable(lengths(rows)))
    at_limit: dict[str, dict[int, float]] = {}
    for source, n, _, p in limits:
        at_limit.setdefault(source, {})[n] = p
    every = sorted({n for _, n, _, _ in limits})
    sizes_there = F.col("text").isNotNull() if not every else ~(F.length(_base(F.col("text"))).isin(every) | F.length("text").isin(every) | F.octet_length("text").isin(every))
    total = rows.count()
    sampled = rows.where("length(text) > 0").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(total, 1)) * (1 << 30)))
    lines = sampled.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)).alias("row"), "tool", "text", sizes_there.alias("plain")).mapInPandas(_sample_lines, "row long, tool string, line string, is_last boolean").toPandas()
    model = fit_ending(lines)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, tool, text in zip(pdf.source, pdf.tool, pdf.text):
                line, note = final_line(text)
                if not line.strip():
                    out.append(-30.0)
                    continue
                body = text
                for m in MARKS:
                    if body.rstrip().endswith(m):
                        body = body.rstrip()[: -len(m)]
                        break
                own = at_limit.get(source, {})
                p = max((own.get(n, 0.0) for n in (len(body), len(text), len(text.encode("utf-8", "surrogatepass")), len(body.encode("utf-8", "surrogatepass")))), default=0.0)
                p = max(p, AFTER_NOTE if note == "broken" else ELSEWHERE)
                p = min(p, 0.98)
                z = model.score(tool, line) + math.log(p / (1 - p))
                before = line_before(text, line, note)
                if before.strip():
                    z = max(z, model.score(tool, before) + math.log(ELSEWHERE / (1 - ELSEWHERE)))
                out.append(z)
            z = np.array(out)
            yield pd.DataFrame({"id": pdf.id, "source": pdf.source, "log_odds": z, "posterior": 1 / (1 + np.exp(-np.clip(z, -50, 50)))})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(score, f"id {kind}, source string, log_odds double, posterior double"), limits
