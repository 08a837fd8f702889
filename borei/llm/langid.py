"""Problem 1: the language of documents and of their segments, by multinomial naive Bayes over hashed n-grams.

The model is a matrix of log-probabilities, n-gram buckets by languages, of fixed size (4 MB); it is broadcast. A batch
of texts is scored as one sparse product: the n-grams of all positions are hashed in numpy, their rows of the matrix
are gathered and summed up, so the score of any stretch is a difference of two rows of the running sums.

A text is cut into units (stretches of one script; words where several languages share it), a Viterbi pass over the
units' scores labels them at a price for each change of language, and stretches of fewer than ``least`` letters go to
the text around them.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import codepoints, latest, map_text, mix, strings
from borei.llm.confusables import _TO_LATIN, _plain

ORDERS, BITS, ALPHA = (1, 2, 3, 4), 17, 0.02
#: Labelled rows used for fitting, at most (those with the smallest hashes of their text).
FIT_ROWS = 20_000
#: Log-probability that a change of language between two units costs; letters of the shortest segment.
CHANGE, LEAST = 18.0, 50

# What the languages are called, as codes and as names, in several of these languages.
NAMES = {
    "km": "km khm khmer cambodian cambodgien ខ្មែរ|central khmer|khmer krom|ភាសាខ្មែរ|tiếng khmer|tiếng khơ-me|khơ-me|bahasa khmer|เขมร|ภาษาเขมร|高棉语|柬埔寨语|ຂະເໝນ",
    "en": "en eng english anglais inggris|bahasa inggris|tiếng anh|英语|英文|អង់គ្លេស|ភាសាអង់គ្លេស|อังกฤษ|ภาษาอังกฤษ|ພາສາອັງກິດ|ອັງກິດ",
    "fr": "fr fra fre french français francais prancis|bahasa prancis|tiếng pháp|法语|法文|បារាំង|ភាសាបារាំង|ฝรั่งเศส|ภาษาฝรั่งเศส|ພາສາຝຣັ່ງ|ຝຣັ່ງ",
    "vi": "vi vie vietnamese vietnamien vietnam|tiếng việt|việt|tieng viet|bahasa vietnam|越南语|越南文|វៀតណាម|ភាសាវៀតណាម|เวียดนาม|ภาษาเวียดนาม|ພາສາຫວຽດນາມ",
    "th": "th tha thai thaï siamese|ไทย|ภาษาไทย|tiếng thái|bahasa thailand|bahasa thai|泰语|泰文|ថៃ|ភាសាថៃ|ພາສາໄທ",
    "lo": "lo lao laotian laotien|ລາວ|ພາສາລາວ|tiếng lào|bahasa laos|bahasa lao|老挝语|寮语|ឡាវ|ភាសាឡាវ|ลาว|ภาษาลาว",
    "zh": "zh zho chi cmn yue chinese chinois mandarin cina tionghoa|中文|汉语|漢語|普通话|国语|华语|bahasa cina|bahasa mandarin|tiếng trung|tiếng hoa|ចិន|ភាសាចិន|จีน|ภาษาจีน|ພາສາຈີນ|simplified chinese|traditional chinese",
    "id": "id ind in indonesian indonésien indonesia|bahasa indonesia|tiếng indonesia|印尼语|印度尼西亚语|ឥណ្ឌូនេស៊ី|ภาษาอินโดนีเซีย|ພາສາອິນໂດເນເຊຍ",
}


@lru_cache(None)
def _named() -> dict[str, str]:
    table = {}
    for code, names in NAMES.items():
        first, *rest = names.split("|")  # the first group holds single words
        for name in [*first.split(), *rest]:
            table[unicodedata.normalize("NFKC", name).casefold()] = code
    return table


@lru_cache(10_000)
def language_code(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names, in any spelling, as a code (with or without region) or as a name."""
    if label is None:
        return None
    label = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", label.replace("​", "")).casefold().strip())
    return _named().get(label) or _named().get(re.split(r"[-_ .(/;,]", label)[0]) or _named().get(re.sub(r"\W*\(.*\)$", "", label))


@dataclass
class LanguageModel:
    """``weights``: log-probabilities, buckets by languages."""

    languages: list[str]
    weights: np.ndarray

    @staticmethod
    def buckets(cps: np.ndarray) -> list[np.ndarray]:
        """For each order, the bucket of the n-gram that begins at each position (the last few wrap to themselves)."""
        out = []
        padded = np.concatenate([cps, np.zeros(max(ORDERS), np.uint32)])
        for n in ORDERS:
            h = np.full(len(cps), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + padded[k : k + len(cps)]
            out.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
        return out

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> LanguageModel:
        languages = sorted(set(labels))
        counts = np.zeros((len(ORDERS), 1 << BITS, len(languages)), np.float64)
        for j, lang in enumerate(languages):
            cps = _read_as()[codepoints([f" {_readable(t)[0]} " for t, x in zip(texts, labels, strict=True) if x == lang])[0]]
            cps = cps[cps > 0]
            for o, h in enumerate(cls.buckets(fold_digits(cps))):
                counts[o, :, j] += np.bincount(h, minlength=1 << BITS)
        weights = np.zeros((1 << BITS, len(languages)))
        for o in range(len(ORDERS)):  # an n-gram's order is part of its hash, so the orders share the buckets
            seen = counts[o].sum(axis=1) > 0
            total = counts[o].sum(axis=0) + ALPHA * (1 << BITS) ** 0.5
            weights[seen] = np.log((counts[o][seen] + ALPHA) / total)
        weights[weights == 0] = np.log(ALPHA / counts.sum(axis=(0, 1))).mean()
        return cls(languages, (weights - weights.mean(axis=1, keepdims=True)).astype(np.float32))

    def sums_at(self, cps: np.ndarray, positions: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Running sums of the scores at sorted positions: the row of b minus the row of a is the score of the n-grams
        that begin in [a, b). Works through the text in steps, so a long one needs no more memory than its positions."""
        out = np.zeros((len(positions), len(self.languages)))
        carry, reach = np.zeros(len(self.languages)), max(ORDERS)
        for lo in range(0, len(cps), step):
            hi = min(lo + step, len(cps))
            scores = np.zeros((hi - lo, len(self.languages)), np.float32)
            for h in self.buckets(cps[lo : hi + reach]):
                scores += self.weights[h[: hi - lo]]
            sums = np.cumsum(scores, axis=0, dtype=np.float64) + carry
            first, last = np.searchsorted(positions, [lo + 1, hi + 1])
            out[first:last] = sums[positions[first:last] - lo - 1]
            carry = sums[-1]
        return out


def fold_digits(cps: np.ndarray) -> np.ndarray:
    """Line breaks as spaces and all digits as one, so that they tell no language."""
    out = cps.copy()
    out[out == 10] = 32
    out[(out >= 48) & (out < 58)] = 48
    return out


# Scripts with one of the model's languages each; Latin letters are shared.
_LATIN, _OTHER = 1, 7
_RANGES = ((0x1780, 0x1800, 2), (0x19E0, 0x1A00, 2), (0xE00, 0xE80, 3), (0xE80, 0xF00, 4), (0x2E80, 0x3000, 5), (0x3005, 0x3008, 5), (0x3400, 0x4DC0, 5), (0x4E00, 0xA000, 5), (0xF900, 0xFB00, 5), (0x20000, 0x32000, 5))


@lru_cache(None)
def _script_table() -> np.ndarray:
    """By code point: its script if it is a letter or mark, else 0. The eighth bit tells letters."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x32000):
        kind = unicodedata.category(chr(cp))
        if kind[0] in "LM":
            letter = 128 if kind[0] == "L" else 0
            own = next((s for lo, hi, s in _RANGES if lo <= cp < hi), None)
            if own is None:
                own = _LATIN if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFF21 <= cp < 0xFF5B else 0 if kind[0] == "M" else _OTHER
            table[cp] = own | letter
    return table


def _merge(parts: list[list], least: int) -> list[list]:
    """Joins neighbours of one language; the shortest part below ``least`` letters joins the longer neighbour."""

    def joined(items: list[list]) -> list[list]:
        out: list[list] = []
        for p in items:
            if out and out[-1][2] == p[2]:
                out[-1][1], out[-1][3] = p[1], out[-1][3] + p[3]
            else:
                out.append(list(p))
        return out

    parts = joined(parts)
    left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
    heap = [(p[3], i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    alive = len(parts)
    gone = [False] * alive

    def absorb(i: int, j: int) -> None:
        """Part i takes in its right neighbour j."""
        parts[i][1], parts[i][3], gone[j], right[i] = parts[j][1], parts[i][3] + parts[j][3], True, right[j]
        if right[j] >= 0:
            left[right[j]] = i

    while alive > 1:
        size, i = heapq.heappop(heap)
        if gone[i] or size != parts[i][3]:
            continue
        if size >= least:
            break
        near = [k for k in (left[i], right[i]) if k >= 0]
        parts[i][2] = parts[max(near, key=lambda k: parts[k][3])][2]
        if right[i] >= 0 and parts[right[i]][2] == parts[i][2]:
            absorb(i, right[i])
            alive -= 1
        if left[i] >= 0 and parts[left[i]][2] == parts[i][2]:
            i = left[i]
            absorb(i, right[i])
            alive -= 1
        heapq.heappush(heap, (parts[i][3], i))
    return [p for p, g in zip(parts, gone, strict=True) if not g]


def _viterbi(scores: np.ndarray, change: float) -> np.ndarray:
    best, back = scores[0], np.zeros(scores.shape, np.int64)
    stay = np.arange(scores.shape[1])
    for t in range(1, len(scores)):
        top = int(best.argmax())
        moved = best[top] - change > best
        back[t] = np.where(moved, top, stay)
        best = np.where(moved, best[top] - change, best) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = int(best.argmax())
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _units(cps: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Where units begin: at a change of script, and at each word of a shared one."""
    strong = np.flatnonzero(script)
    if not len(strong):
        return np.zeros(0, np.int64)
    s = script[strong]
    apart = np.diff(strong) > 1
    begin = np.ones(len(strong), bool)
    begin[1:] = (s[1:] != s[:-1]) | (apart & ((s[1:] == _LATIN) | (s[1:] == _OTHER)))
    at = strong[begin]
    at[0] = 0
    return at


@lru_cache(None)
def _read_as() -> np.ndarray:
    """By code point: what it is read as, one for one (plain forms, Latin for its look-alikes); 0 for invisible ones."""
    table = np.arange(0x110000, dtype=np.uint32)
    for cp, to in _plain().items():
        if len(to) < 2:
            table[cp] = ord(to.lower()[0]) if to else 0
    for own, latin in _TO_LATIN.items():
        table[ord(own)] = ord(latin.lower())
    return table


_ACCENTS = re.compile("[A-Za-z\u00c0-\u024f\u1ea0-\u1eff][\u0300-\u036f]+")


def _readable(text: str | None) -> tuple[str, list[int] | None]:
    """The text in lower case, as long as itself; or with accents composed, and the position of each character."""
    text = text or ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not _ACCENTS.search(low):
        return low, None
    out, at, end = [], [], 0
    for m in _ACCENTS.finditer(low):
        composed = unicodedata.normalize("NFC", m[0])
        out += [low[end : m.start()], composed]
        at += [*range(end, m.start()), *[m.start()] * len(composed)]
        end = m.end()
    return "".join([*out, low[end:]]), [*at, *range(end, len(low)), len(low)]


def detect(texts: list[str | None], model: LanguageModel, least: int = LEAST, change: float = CHANGE) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its segments (start, end, language, confidence, letters), covering it from end to end. A text
    without letters has none."""
    read = [_readable(t) for t in texts]
    stored, first = codepoints([r[0] for r in read])
    cps = _read_as()[stored]
    seen = np.flatnonzero(cps)
    cps, starts = cps[seen], np.searchsorted(seen, first)
    if not len(cps):
        return [[] for _ in texts]
    kinds = _script_table()[cps]
    letters = np.concatenate([[0], np.cumsum(kinds >> 7)])
    script = kinds & 127
    edges = [np.append(_units(cps[a:b], script[a:b]) + a, b) if letters[b] > letters[a] else np.zeros(0, np.int64) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    sums = model.sums_at(fold_digits(cps), np.concatenate(edges))
    out, used = [], 0
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        at = edges[i]
        own = sums[used : used + len(at)]
        used += len(at)
        if not len(at):
            out.append([])
            continue
        path = _viterbi(np.diff(own, axis=0), change)
        parts = _merge([[j, j + 1, int(k), int(letters[at[j + 1]] - letters[at[j]])] for j, k in enumerate(path)], least)
        found = []
        for x, y, k, n in parts:
            s = (own[y] - own[x]) / len(ORDERS)  # the orders see the same letters: they count as one
            p = np.exp(np.clip(s - s.max(), -700, 0))
            lo, hi = (int(seen[at[x]]) if at[x] > a else int(first[i])) - int(first[i]), (int(seen[at[y]]) if at[y] < b else int(first[i + 1])) - int(first[i])
            if read[i][1] is not None:
                lo, hi = read[i][1][lo], read[i][1][hi]
            found.append((lo, hi, model.languages[k], float(p[k] / p.sum()), n))
        out.append(found)
    return out


def fit_model(samples: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> LanguageModel:
    """A model from at most ``rows`` labelled rows. Rows with a null are left out."""
    part = samples.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null").orderBy(F.xxhash64("t"), "t", "l").limit(rows).collect()
    return LanguageModel.fit([r.t for r in part], [r.l for r in part])


SEGMENTS = "array<struct<seg_no:int,start_pos:int,end_pos:int,lang:string,confidence:double,letters:int>>"


def with_languages(df: DataFrame, model: LanguageModel, key: str = "id", text: str = "text", carry: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """``key``, the ``carry`` columns, and of each row's text: ``lang`` and ``confidence`` of most of its letters, and
    ``segments`` in one language each. Null texts and texts without letters give null and no segments."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("seg_no", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = detect(strings(batch, "_text"), shared.value, least)
        main = [max(f, key=lambda s: s[4]) if f else None for f in found]
        rows = [[{"seg_no": i + 1, "start_pos": s[0], "end_pos": s[1], "lang": s[2], "confidence": s[3], "letters": s[4]} for i, s in enumerate(f)] for f in found]
        extra = [pa.array([m and m[2] for m in main], pa.string()), pa.array([m and m[3] for m in main], pa.float64()), pa.array(rows, kinds)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1 + len(carry))), *extra], [key, *carry, "lang", "confidence", "segments"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *carry))
    return map_text(df.select(key, *carry, F.col(text).alias("_text")), "_text", run, f"{own}, lang string, confidence double, segments {SEGMENTS}")


def mislabelled_segments(docs: DataFrame, model: LanguageModel, key: str = "id", text: str = "text", label: str = "language", order: str = "loaded_at") -> DataFrame:
    """(``key``, ``seg_no``, ``lang``): the segments of each document whose label is missing, names no language or
    another than its text's, and of each document that mixes languages. A record delivered again counts once, as it
    was delivered last; texts without letters give no row; rows without a key are records of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cases = []
        for found, name in zip(detect(strings(batch, "_text"), shared.value), strings(batch, "_label"), strict=True):
            langs = [s[2] for s in found]
            cases.append(langs if len(langs) > 1 or (langs and language_code(name) != langs[0]) else [])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cases, pa.list_(pa.string()))], [key, order, "langs"])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, order))
    found = map_text(docs.select(key, order, F.col(label).alias("_label"), F.col(text).alias("_text")), "_text", run, f"{own}, langs array<string>")
    return latest(found, [key], ["langs"], order).select(key, F.posexplode("langs").alias("_at", "lang")).select(key, (F.col("_at") + 1).alias("seg_no"), "lang")
