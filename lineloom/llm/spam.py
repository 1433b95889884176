"""Keyword-stuffed and link-list pages (problem 9).

Every document gets content and link features. Weak labels come from a few seeds, rules with extreme thresholds that are
sure of a small part of the pages of either kind and leave the rest open. Bagged decision trees are trained on a
bounded sample of documents (``SAMPLE_DOCS``, hashed by id) that the seeds label, with random subsets of rows and of
features at every split; what they are then sure of among the open documents of the sample joins the labels of another
training (``SURE``, ``ROUNDS``). The last trees score all documents; the seeds decide nothing. A page's score is then smoothed with the
spam rate of the hosts it names: the mean score of the other pages that name a host, drawn to the overall rate by
``HOST_WEIGHT`` pages, moves the page's log-odds by ``HOST_PULL`` of its own distance from the overall log-odds.

Null, empty and white-space texts are never spam. Repeated rows have equal features and page scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stable

SAMPLE_DOCS = 10_000
TREES = 25
DEPTH = 7
LEAST_LEAF = 5
HOST_WEIGHT, HOST_PULL = 5.0, 0.5
#: Spam is a small part, and the seeds know less of it than of the rest, so scores are low.
THRESHOLD = 0.25
#: Scores below and above which trees label what the seeds left open, and how often new trees are trained on that.
SURE, ROUNDS = (0.08, 0.85), 2

_URL = re.compile(r"(?:https?://|www\.)[^\s<>()\[\]\"']+", re.I)
_SITE = re.compile(r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:com|net|org|info|biz|io|example|test|invalid)\b(?:/[^\s<>()\[\]\"',]*)?")
_HOST = re.compile(r"^(?:https?://)?(?:www\.)?([^/\s:?#]+)", re.I)
#: Ends of site names.
_ENDINGS = (".com", ".net", ".org", ".info", ".biz", ".io", ".example", ".test", ".invalid")
_TAG = re.compile(r"(?<!\w)#[A-Za-z][\w-]*")
_WORD = re.compile(r"[^\W_]+")
_MONEY = re.compile(rb"9[.,]99(?![9.,])")
#: Signs that end a segment, wherever they stand.
_CUTS = bytes(10 if chr(c) in "|/,;.?!" else c for c in range(256))
_WIDE_CUTS = dict.fromkeys(map(ord, "|/,;.?!·•»"), "\n")
_BLANKS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_KINDS = bytes(ord("a" if chr(c).islower() else "A" if chr(c).isupper() else "9" if chr(c).isdigit() or c == 64 else chr(c)) if c < 128 else 63 for c in range(256))
_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_PLAIN = str.maketrans("013457@", "oleasta")
_ENDS = (".", "?", "!", "。", '."', ".'", ".)", '?"', ".\"\"\"")
_SIGNS = "_(){}[]=;:/|#,.<>\"'`*-"
_SIGN_CODES = np.frombuffer(_SIGNS.encode(), np.uint8)

FEATURES = [
    "chars", "lines", "words", "words_line", "unique", "bigram_rep", "url_chars", "hosts_line", "url_lines", "explained", "tag_chars", "prices", "times", "sentence_lines", "sentence_chars", "long_sentences", "stem_rep",
    "segment_rep", "segment_words", "line_rep", "shape_top", "count_ends", "caps", "leet", "leet_rep", "word_len", "digits", "not_ascii", "wide_stops", "asks", "inner_rep",
    *(f"sign_{c}" for c in _SIGNS),
]


def _rep(items: list) -> float:
    return 1 - len(set(items)) / len(items) if items else 0.0


def _explained(line: str) -> bool:
    """Whether a line with a link has a sentence beside it."""
    rest = _URL.sub(" ", line).rstrip()
    return rest.count(" ") >= 6 and (rest.endswith(_ENDS) or ". " in rest)


def features(text: str) -> tuple[list[float], list[str]]:
    """(the features of one text, in the order of ``FEATURES``, hosts it names); shares are of words, lines or characters."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    n_chars, n_lines = max(1, len(text)), max(1, len(lines))
    low = text.lower()
    ascii_ = text.isascii()
    urls = _URL.findall(low) if "://" in low or "www." in low else []
    bare = _URL.sub(" ", low) if urls else low
    if any(e in bare for e in _ENDINGS) and (sites := _SITE.findall(bare)):
        urls, bare = urls + sites, _SITE.sub(" ", bare)
    tags = _TAG.findall(bare) if "#" in bare else []
    cut = bare.replace(". ", "\n").replace("? ", "\n").replace("! ", "\n")
    if ascii_:
        flat = bare.encode().translate(_BLANKS)
        words, letters = flat.split(), len(flat) - flat.count(b" ")
        parts = [x.strip() for x in cut.replace(" - ", "\n").encode().translate(_CUTS).split(b"\n")]
    else:
        cut = cut.replace("。", "\n")
        words = _WORD.findall(bare)
        letters = sum(map(len, words))
        parts = [x.strip() for x in cut.replace(" - ", "\n").replace(" – ", "\n").translate(_WIDE_CUTS).split("\n")]
    segments = [x for x in parts if x]
    n = max(1, len(words))
    hosts = sorted({m.group(1) for u in urls if (m := _HOST.match(u))})
    raw = text.encode("ascii", "replace")
    kinds = raw.translate(_KINDS)
    url_lines = explained = sentence_lines = sentence_chars = counted = 0
    for line in lines:
        tail = line.rstrip()
        good = (tail.endswith(_ENDS) and tail.count(" ") >= 4) or (not ascii_ and tail[-1] == "。")
        if urls and ("://" in line or _URL.search(line) or _SITE.search(line.lower())):
            url_lines += 1
            good = _explained(line)
            explained += good
        if good:
            sentence_lines += 1
            sentence_chars += len(line)
        elif tail[-1].isdigit():
            counted += tail.rsplit(None, 1)[-1].isdigit()
    shapes = Counter(kinds.translate(None, b"aA9 ").split(b"\n"))
    shapes.pop(b"", 0)
    sentences = [s for s in cut.split("\n") if s and not s.isspace()]
    inner = [1 - len(set(w)) / len(w) for s in sentences if len(w := s.split()) > 2]
    stems = [" ".join(s.split(None, 2)[:2]) for s in sentences]
    plain = kinds.replace(b"A", b"a")
    mixed = plain.count(b"a9a")
    pair_rep = leet_rep = _rep(list(zip(words, words[1:])))
    if mixed > 0.03 * n:
        w = bare.translate(_PLAIN).split()
        leet_rep = _rep(list(zip(w, w[1:])))
    signs = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    x = [
        math.log1p(n_chars), math.log1p(n_lines), math.log1p(n), n / n_lines, len(set(words)) / n, pair_rep, sum(map(len, urls)) / n_chars, len(hosts) / n_lines, url_lines / n_lines, explained / max(1, url_lines), sum(map(len, tags)) / n_chars,
        (len(_MONEY.findall(plain)) + low.count("sku ") + int(signs[36])) / n_lines, (plain.count(b"99:99") + plain.count(b"9999-99-99")) / n_lines, sentence_lines / n_lines, sentence_chars / n_chars, sum(s.count(" ") >= 6 for s in sentences) / max(1, len(sentences)), _rep(stems),
        _rep(segments), n / max(1, len(segments)), 1 - len(set(lines)) / n_lines, max(shapes.values(), default=0) / n_lines, counted / n_lines, (kinds.count(b"aA") + kinds.count(b"9A")) / n, mixed / n, leet_rep, letters / n, int(signs[48:58].sum()) / n_chars, 0.0 if ascii_ else 1 - len(text.encode("ascii", "ignore")) / n_chars, text.count("。") / n_lines,
        (text.count("?") + text.count("!")) / max(1, len(sentences)), sum(inner) / max(1, len(inner)),
        *(signs[_SIGN_CODES] / n_chars).tolist(),
    ]
    return x, hosts


def seeds(x: np.ndarray) -> np.ndarray:
    """1 surely spam, 0 surely not, -1 open; x: (documents, features). Rules of extreme values only."""
    c = {name: x[:, i] for i, name in enumerate(FEATURES)}
    code = c["sign_("] + c["sign_="] + c["sign_{"]
    calm = (c["words"] > math.log1p(15)) & (c["times"] == 0) & (c["count_ends"] < 0.2) & (code < 0.02)
    spam = calm & (
        ((c["bigram_rep"] > 0.75) & (c["segment_rep"] > 0.7) & (c["sentence_chars"] < 0.1))
        | ((c["unique"] < 0.14) & (c["stem_rep"] > 0.5) & (c["bigram_rep"] > 0.6))
        | ((c["caps"] > 1.1) & (c["leet_rep"] > 0.65) & (c["sentence_chars"] < 0.1))
        | ((c["url_lines"] > 0.95) & (c["url_chars"] > 0.6) & (c["explained"] == 0))
        | (c["tag_chars"] > 0.8)
        | ((c["prices"] > 0.9) & (c["shape_top"] > 0.9))
    )
    dry = (c["url_chars"] < 0.1) & (c["tag_chars"] < 0.1) & (c["prices"] < 0.2)
    ham = dry & (
        ((c["sentence_chars"] > 0.9) & (c["bigram_rep"] < 0.02))
        | ((c["sentence_chars"] > 0.8) & (c["inner_rep"] < 0.06) & (c["long_sentences"] > 0.5) & (c["asks"] < 0.1) & (c["bigram_rep"] > 0.15))
        | ((code > 0.06) & (c["bigram_rep"] < 0.3))
        | ((c["digits"] > 0.12) & (c["bigram_rep"] < 0.25) & (c["words"] > math.log1p(15)))
        | (c["count_ends"] > 0.6)
    )
    ham |= dry & (c["sign__"] > 0.015) & (c["bigram_rep"] < 0.25) & (c["unique"] > 0.5) & (c["sentence_chars"] < 0.5)
    ham |= (c["explained"] > 0.8) & (c["sentence_chars"] > 0.6)
    ham |= (c["words"] < math.log1p(8)) & (c["url_chars"] == 0)
    return np.where(spam & ~ham, 1, np.where(ham & ~spam, 0, -1))


class Tree:
    """A decision tree as arrays: feature (-1: leaf), threshold, children, value."""

    def __init__(self):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self, value: float) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, value)):
            a.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, t, l, r, v = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            inner = f[at] >= 0
            if not inner.any():
                break
            i = np.flatnonzero(inner)
            go = x[i, f[at[i]]] <= t[at[i]]
            at[i] = np.where(go, l[at[i]], r[at[i]])
        return v[at]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rng: np.random.Generator, bins: int = 24) -> Tree:
    """CART on Gini impurity; a random third of the features at every split."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    tree = Tree()

    def split(rows: np.ndarray, depth: int) -> int:
        ww, yy = w[rows], y[rows]
        total, ones = ww.sum(), (ww * yy).sum()
        node = tree.add(ones / total)
        if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or ones in (0, total):
            return node
        best = (1e-9, -1, 0)
        for j in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            k = len(edges[j])
            if not k:
                continue
            b = binned[rows, j]
            n = np.cumsum(np.bincount(b, ww, k + 1))[:-1]
            p = np.cumsum(np.bincount(b, ww * yy, k + 1))[:-1]
            c = np.cumsum(np.bincount(b, minlength=k + 1))[:-1]
            ok = (c >= LEAST_LEAF) & (len(rows) - c >= LEAST_LEAF)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, p * p / n + (ones - p) ** 2 / (total - n) + (n - p) ** 2 / n + (total - n - ones + p) ** 2 / (total - n) - (ones**2 + (total - ones) ** 2) / total, -1)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), int(j), at)
        if best[1] < 0:
            return node
        _, j, at = best
        go = binned[rows, j] <= at
        tree.feature[node], tree.threshold[node] = j, float(edges[j][at])
        tree.left[node] = split(rows[go], depth + 1)
        tree.right[node] = split(rows[~go], depth + 1)
        return node

    split(np.arange(len(y)), 0)
    return tree


def fit(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Tree]:
    """Bagged trees on the rows of ``x`` with a label (``y`` of 0 or 1, -1 for none); none if a class has no row."""
    x, y = x[y >= 0], y[y >= 0].astype(float)
    if not len(y) or y.min() == y.max():
        return []
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    balance = np.where(y == 1, np.minimum(balance, 8 * balance.min()), balance)
    trees = []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        trees.append(grow(x[rows], y[rows], balance[rows], rng))
    return trees


def vote(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([t.predict(x) for t in trees], axis=0) if trees else np.zeros(len(x))


def page(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    """Scores of pages; 0 for texts without words."""
    return np.where(x[:, FEATURES.index("unique")] > 0, vote(trees, x), 0.0)


def train(x: np.ndarray, seed: int = 5) -> list[Tree]:
    """Trees on what the seeds label, and on what those trees are sure of; no trees if the seeds lack a class."""
    rng = np.random.default_rng(seed)
    y = seeds(x)
    trees = fit(x, y, rng)
    for _ in range(ROUNDS if trees else 0):
        p = vote(trees, x)
        trees = fit(x, np.where(y >= 0, y, np.where(p > SURE[1], 1, np.where(p < SURE[0], 0, -1))), rng)
    return trees


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [features(text) for text in pdf.text]
        yield pd.DataFrame({"id": pdf.id, "x": [np.array(x, np.float32) for x, _ in rows], "hosts": [h for _, h in rows]})


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, page (the trees' score), host_rate (null without another page of a named host), score, is_spam."""
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    feat = stable(rows.mapInPandas(_featured, f"id {kind}, x array<float>, hosts array<string>"))
    total = max(feat.count(), 1)
    part = feat.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / total) * (1 << 30)))
    sample = part.select("x").toArrow().combine_chunks()
    trees = train(sample.column("x").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, len(FEATURES))) if sample.num_rows else []

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf.id, "page": page(trees, np.stack(pdf.x.to_list())), "hosts": pdf.hosts})

    pages = stable(feat.mapInPandas(score, f"id {kind}, page double, hosts array<string>"))
    return smoothed(pages).withColumnRenamed("id", id_col)


def smoothed(pages: DataFrame) -> DataFrame:
    """id, page, host_rate, score, is_spam of pages (id, page, hosts)."""
    odds = lambda p: F.log(F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)) / (1 - F.greatest(F.lit(0.01), F.least(F.lit(0.99), p))))
    base = pages.agg(F.avg("page")).first()[0] or 0.0
    named = pages.select("id", "page", F.explode("hosts").alias("host")).withColumn("host", F.xxhash64("host"))
    shared = named.groupBy("host").agg(F.sum("page").alias("all"), F.count("*").alias("n")).where("n > 1")
    rate = (
        named.join(shared, "host")
        .withColumn("rate", (F.col("all") - F.col("page") + HOST_WEIGHT * base) / (F.col("n") - 1 + HOST_WEIGHT))
        .groupBy("id")
        .agg(F.avg("rate").alias("host_rate"))
    )
    out = pages.select("id", "page").join(rate, "id", "left")
    moved = 1 / (1 + F.exp(-(odds(F.col("page")) + HOST_PULL * (odds(F.col("host_rate")) - odds(F.lit(base))))))
    out = out.withColumn("score", F.when(F.col("host_rate").isNull(), F.col("page")).otherwise(moved))
    return out.withColumn("is_spam", F.col("score") > THRESHOLD)
