"""Problem 9: pages made of repeated keywords, links or product tags rather than sentences.

Each page is cut into units (lines, and sentences within them) that are prose or not by what they hold: marks at their
ends, links, tags, codes, separators, repeated words. Content and link features of a bounded sample of pages, labelled
weakly by votes of separate signs, train bagged decision trees; all pages are then scored by the trees in numpy, scores
are smoothed with the spam rate of their host, and the pages with a smoothed score of one half or more are found. The
share of prose is one of the features; nothing but the score decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import hash_sample, lists, map_text, strings
from borei.llm.sentences import sentences
from borei.session import use_checkpoints

#: Weakly labelled pages that train the trees, at most (those with the smallest hashes of their text).
FIT_ROWS = 20_000
#: Code points of a text below which it is no case.
SHORT = 40
#: Score after smoothing from which a page is found; weight of its host; pages worth of prior in a host's rate.
FOUND, HOST_WEIGHT, HOST_PRIOR = 0.5, 0.15, 20.0

_HTML = re.compile(r"</?(?![Aa]\b[^<>]*://)[A-Za-z][^<>]{0,80}>")
_LINK = re.compile(r"\(?(?:https?://|www\.)[^\s)|,;]+\)?", re.IGNORECASE)
_TAG = re.compile(r"(?<!\S)#\S+")
_SLUG = re.compile(r"(?<!\S)[^\s,;|-]+(?:-[^\s,;|-]+)+(?=[,;|\s]|$)")
_LABEL = re.compile(r"(?<!\S)[A-Za-z]{2,12}:(?=\s?\S)")
_CODE = re.compile(r"(?<!\S)(?:[A-Z]{4,}|\d+(?:-\d+)*)(?!\S)")
_ARTICLE = re.compile(r"(?<![^\W_])[A-Z]{2,5}-?\d{3,}(?![^\W_])")
_DIGIT = re.compile(r"\d")
_SEPARATOR = re.compile(r"[|·»•›;/~=]|(?<=\s)[-–—*](?=\s)")
_END = re.compile(r"[.!?។៕。！？…][\s”»\"')）]*$")
_TAI = re.compile("[ก-ฺเ-๎ກ-ຽເ-໎ໜ-ໟ]")
_HAN = re.compile("[一-鿿]")
FEATURES = ("prose", "prose_strict", "prose_units", "links", "tags", "separators", "ends", "unit_letters", "repeated_grams", "repeated_units", "labels", "codes", "units_short", "articles", "page_repeats")


def _lines(text: str) -> list[str]:
    """Lines that hold something; lines of a single word are one line with their neighbours."""
    out: list[str] = []
    alone = False
    for line in (_HTML.sub(" ", text) if "<" in text else text).split("\n"):
        line = line.strip()
        if line:
            one = len(line) < 20 and line[0] != "#" and " " not in line and not _LINK.match(line)
            if one and alone:
                out[-1] += " " + line
            else:
                out.append(line)
            alone = one
    return out


def _fresh(text: str, size: int = 5) -> float:
    """The share of the text's n-grams that are its first of their kind."""
    n = len(text) - size + 1
    return len({text[i : i + size] for i in range(n)}) / n if n > 0 else 1.0


def _is_prose(unit: str, bare: str, odd: int, fresh: float, heads: dict[str, int]) -> int:
    """2: surely a sentence, 1: likely (no mark at its end), 0: none. ``bare`` is the unit without links and tags,
    ``odd`` what else in it is no prose."""
    size, kept = len(unit), len(bare)
    if kept < 0.6 * size or (kept >= 40 and fresh < 0.6) or (odd > 2 and odd > kept / 45):
        return 0
    if len(_TAI.findall(bare)) >= 25:  # no marks end sentences, but a separator every few words makes a list
        return 0 if odd > kept / 40 else 2
    if kept < (8 if len(_HAN.findall(bare)) > 4 else 18):
        return 0
    if _END.search(unit):
        return 0 if kept < 32 and heads.get(unit.split(None, 1)[0].lower(), 0) > 3 and not _HAN.search(bare) else 2
    commas = bare.count(",")
    if (commas > 3 and commas > kept / 22) or kept < 45 or odd > max(1, kept / 60):
        return 0
    words = bare.split(None, 2)
    return 1 if len(words) >= 2 and heads.get(words[0].lower(), 0) < 3 else 0


def features(units: list[str]) -> np.ndarray:
    """FEATURES of a page from its units, all but ``unit_letters`` and ``ends`` as shares."""
    size = max(1, sum(len(u) for u in units))
    heads: dict[str, int] = {}
    for u in units:
        w = u.split(None, 1)[:1]
        if w:
            heads[w[0].lower()] = heads.get(w[0].lower(), 0) + 1
    prose = strict = prose_units = links = tags = seps = ends = labels = codes = short = articles = 0
    stale = 0.0
    for u in units:
        bare = u
        if "www." in u or "://" in u or "WWW." in u:
            bare = _LINK.sub(" ", bare)
            links += len(u) - len(bare)
        if "#" in bare:
            less = _TAG.sub(" ", bare)
            tags += len(bare) - len(less)
            bare = less
        bare = bare.strip()
        s, l = len(_SEPARATOR.findall(bare)), len(_LABEL.findall(bare)) if ":" in bare else 0
        capitals = _CODE.findall(bare)
        if len(capitals) > 4:  # text in capitals is no list of codes
            capitals = [x for x in capitals if not x.isalpha()]
        c = len(capitals), len(_SLUG.findall(bare)) if "-" in bare else 0
        fresh, a = _fresh(bare), len(_ARTICLE.findall(bare))
        kind = _is_prose(u, bare, s + l + c[1] + c[0] // 2 + a, fresh, heads)
        prose += len(u) * (kind > 0)
        strict += len(u) * (kind == 2)
        prose_units += kind > 0
        seps, labels, codes = seps + s, labels + l, codes + sum(c)
        articles += a
        stale += (1 - fresh) * len(u)
        ends += bool(_END.search(u))
        short += len(u) < 40
    n = max(1, len(units))
    alike = 1 - len({u[:16] for u in units}) / n
    return np.array([prose / size, strict / size, prose_units / n, links / size, tags / size, 20 * seps / size, 70 * ends / size, min(size / n, 200.0), stale / size, alike, 10 * labels / size, 10 * codes / size, short / n, 20 * articles / size, 1 - _fresh(_DIGIT.sub("0", "".join(units)), 8)], np.float32)


def _matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts, and which of them are long enough to be judged."""
    judged = np.array([t is not None and len(t.strip()) >= SHORT for t in texts], bool)
    rows = np.zeros((len(texts), len(FEATURES)), np.float32)
    at = np.flatnonzero(judged)
    lines = [_lines(texts[i]) for i in at]
    spans = iter(sentences([line for page in lines for line in page]))
    for i, page in zip(at, lines, strict=True):
        rows[i] = features([line[a:b] for line in page for a, b in (next(spans) or [(0, len(line))])])
    return rows, judged


# --- bagged trees -----------------------------------------------------------------------------------------------------


class Trees:
    """Bagged decision trees as flat arrays: each node has a feature (or -1), a threshold, two children and a value."""

    def __init__(self, nodes: list[np.ndarray]):
        self.nodes = nodes

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, columns: int, out: list) -> int:
        at = len(out)
        out.append([-1.0, 0.0, 0.0, 0.0, float((y.sum() + 0.5) / (len(y) + 1))])
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return at
        best = (y.mean() * (1 - y.mean()) - 1e-6, -1, 0.0)
        for f in rng.choice(x.shape[1], columns, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            cut = np.flatnonzero(np.diff(v) > 0)
            if not len(cut):
                continue
            left, ones = cut + 1, np.cumsum(t)[cut]
            right, rest = len(y) - left, t.sum() - ones
            gini = (ones * (left - ones) / left + rest * (right - rest) / right) / len(y)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                best = (gini[k], int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            return at
        goes = x[:, best[1]] <= best[2]
        out[at][0], out[at][1] = best[1], best[2]
        out[at][2] = Trees._grow(x[goes], y[goes], rng, depth - 1, columns, out)
        out[at][3] = Trees._grow(x[~goes], y[~goes], rng, depth - 1, columns, out)
        return at

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, columns: int = 5, seed: int = 7) -> Trees:
        rng, nodes = np.random.default_rng(seed), []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            out: list = []
            cls._grow(x[rows], y[rows].astype(np.float64), rng, depth, columns, out)
            nodes.append(np.array(out))
        return cls(nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.nodes:
            at = np.zeros(len(x), np.int64)
            while True:
                f = tree[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(low, tree[at, 2], tree[at, 3]).astype(np.int64), at)
            total += tree[at, 4]
        return total / len(self.nodes)


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 for clear spam, 0 for clear prose, -1 for pages in between, by votes of separate signs: pages of little prose
    with a sign of spam, and pages of prose with no more than one."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    signs = (f["links"] > 0.3).astype(int) + (f["tags"] > 0.3) + (f["repeated_grams"] > 0.5) + (f["separators"] > 0.3) + (f["ends"] < 0.1) + (f["labels"] > 0.2) + (f["units_short"] > 0.8) + (f["codes"] > 0.2) + (f["articles"] > 0.3) + (f["page_repeats"] > 0.5)
    return np.where((f["prose"] < 0.4) & (signs >= 1), 1, np.where((f["prose"] > 0.6) & ((signs < 2) | (f["prose_strict"] > 0.9)), 0, -1))


def fit_trees(pages: DataFrame, text: str = "text", rows: int = FIT_ROWS) -> Trees | None:
    """Trees from at most ``rows`` pages, weakly labelled; None where they give one class only."""
    part = hash_sample(pages.select(F.col(text).alias("_text")), "_text", rows).select("_h", "_text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, judged = _matrix(strings(batch, "_text"))
        at = pa.array(np.flatnonzero(judged), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), lists(x[judged].reshape(-1), np.full(len(at), len(FEATURES)), pa.float32())], ["h", "x"])

    found = map_text(part, "_text", run, "h bigint, x array<float>").dropDuplicates(["h"]).toArrow()
    rows_x = [x for _, x in sorted(zip(found.column("h").to_pylist(), found.column("x").to_pylist(), strict=True))]
    x = np.array(rows_x, np.float32).reshape(-1, len(FEATURES))
    y = weak_labels(x)
    sure, y = x[y >= 0], y[y >= 0]
    if not len(y) or y.min() == y.max():
        return None
    return Trees.fit(sure, y)


def scored_pages(pages: DataFrame, trees: Trees | None, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``key``, ``host``, ``score`` of the trees and ``prose``, the share of each judged page's text in sentences."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, judged = _matrix(strings(batch, "_text"))
        rows = pa.array(np.flatnonzero(judged), pa.int64())
        x = x[judged]
        score = shared.value.score(x) if shared.value is not None else 1.0 - x[:, 0]
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(score.astype(np.float64), pa.float64()), pa.array(x[:, 0].astype(np.float64), pa.float64())], [key, "host", "score", "prose"])

    kind = pages.schema[key].dataType.simpleString()
    return map_text(pages.select(key, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("_text")), "_text", run, f"`{key}` {kind}, host string, score double, prose double")


def spam_pages(pages: DataFrame, trees: Trees | None, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``key`` of each page more than half of which isn't sentences, as the trees and its host tell, with its score.

    Host rates are sums over all judged pages, pre-aggregated map-side, so a host with a third of all pages is one row
    of a small table. Null, blank and short texts are never found; a null host is one host."""
    use_checkpoints(pages.sparkSession)
    scored = scored_pages(pages, trees, key, host, text).checkpoint()  # read twice below
    hosts = scored.groupBy("host").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = sums.s / sums.n if sums.n else 0.05
    rates = hosts.select("host", ((F.col("s") + HOST_PRIOR * overall) / (F.col("n") + HOST_PRIOR)).alias("rate"))

    def logit(c):
        c = F.least(F.greatest(c, F.lit(0.005)), F.lit(0.995))
        return F.log(c / (1 - c))

    smooth = 1 / (1 + F.exp(-(logit(F.col("score")) + HOST_WEIGHT * (logit(F.col("rate")) - logit(F.lit(overall))))))
    near = scored.join(rates, "host").select(key, "host", smooth.alias("score"), "prose")
    return near.where(F.col("score") >= FOUND)
