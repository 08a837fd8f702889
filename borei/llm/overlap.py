"""Problem 5: records of evaluation splits that also occur, exactly or almost, in the training split.

Texts are folded to letters and digits. Two kinds of hashes are partitioned and joined, evaluation against training:

* **Segments** find every pair whose edit distance is below a tenth. Of a training text of n letters fewer than n / 9 are
  touched, so of any ceil(n / 9) - 1 + r disjoint segments r are whole in the evaluation text. For j from 1 to r, take
  the last i up to the end of whose segment (or for 0, the start) there are more than i - j edits: the next segment holds
  none, fewer stand before it than its ordinal, at most what is left plus r minus its ordinal after it, and through the end of
  the segment after it there is one at most. The first two bound how far it has moved, the third the letters that follow:
  nearly all chance matches fail one of these. A training text offers as many of its pieces (r up to REPEAT where so
  many fit), those that are rarest among evaluation texts and disjoint, so that phrases of many texts are passed over; an
  evaluation text offers all its pieces of the sizes it may need.
* **Grams** find texts whose sentences moved. Hashed 12-grams of letters (words can't be told apart in half of the
  languages) are thinned by winnowing; of m kept ones each text offers the rarest m - ceil(SHARE * m) + 4, so that two
  texts that share half of theirs meet in four. Edits that are scattered over a text whose sentences moved as
  well may leave fewer; the README has the measured recall.

What is rare, and what the other side doesn't have at all, is told by tables of fixed size over all records, joined by a
tree of tasks; they decide only how much is sent and compared in vain. The records that meet are compared in full: the edit distance of the folded texts,
and, if it is too large, of their sentences in the best order. Equal texts are one class: offered once per task,
compared once, and expanded by their 128-bit digests at the end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borei.llm._text import grams, map_text, owners, slices, strings, table_sums, take
from borei.llm.folding import fold
from borei.session import ship, spread, use_checkpoints

GRAM, WINDOW, SHARE = 12, 6, 0.5
#: Offers in which two texts must meet, if they must share so many.
MEET = 4
#: Counters of the rarity table, half of them for each kind of hash: 2 MB whatever the data.
BITS = 21
#: A pair counts if less than this part of its letters and digits differs.
DIFFER = 0.1
#: Letters of a segment, in texts that are long enough for ceil(n / 9) of them.
SEGMENT = 7
#: Whole segments that two texts must share, where the training text has so many more than edits.
REPEAT = 3
#: Letters of a block, at least, among whose pieces the segments are chosen; blocks that are chosen from side by side.
BLOCK, ASIDE = 128, 512
EVALUATION, TRAINING = 1, 2
_APART = np.uint64(1 << 47)  # no gram has the hash of a segment
#: Bits of a sieve, which tells what the other side doesn't have: 16 MB whatever the data.
SIEVE = 27


def by_text(text: np.ndarray, keys: np.ndarray, stable: bool = False) -> np.ndarray:
    """The order by text, then by key, with equal ones as they are if it must be ``stable``; small numbers are sorted by
    their digits."""
    order = np.argsort(keys, kind="stable" if stable else None)
    if len(text):
        text = text.astype(np.min_scalar_type(int(text.max())))
    return order[np.argsort(text[order], kind="stable")]


def winnow(cps: np.ndarray, starts: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the kept n-grams of all texts, and the text of each; each hash once per text. A text shorter than an
    n-gram has none (its segments are all of it)."""
    lengths = np.diff(starts)
    h = grams(cps, gram)
    keep = np.zeros(len(h), bool)
    if len(h) >= window:
        least = h[: len(h) - window + 1].copy()
        for k in range(1, window):
            np.minimum(least, h[k : k + len(least)], out=least)
        for k in range(window):
            keep[k : k + len(least)] |= h[k : k + len(least)] == least
    text = owners(starts)[: len(h)]
    keep |= (lengths < gram + window - 1)[text]  # too short for a window: all n-grams
    keep &= np.arange(len(h)) + gram <= starts[text + 1]
    values, text = h[keep], text[keep]
    order = by_text(text, values)
    values, text = values[order], text[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[first], text[first]


def segment_size(n: int) -> int:
    """Letters of the segments of a text of n: SEGMENT where ceil(n / 9) of them fit, else what fits; up to nine letters
    are one segment (no edit is less than a tenth of them)."""
    need = -(-n // 9)
    return n if n <= 9 else SEGMENT if n // SEGMENT >= need else n // need


@lru_cache(None)
def _sizes_near(n: int) -> frozenset[int]:
    """Segment sizes of the texts that can differ from one of n letters by less than a tenth."""
    if n > 40:
        return frozenset({SEGMENT})
    return frozenset(segment_size(k) for k in range(max(1, n - n // 9 - 1), n + n // 9 + 2) if abs(n - k) * 10 < max(n, k))


def _cell(values: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return (values >> np.uint64(65 - bits)).astype(np.int64) + kind * (1 << (bits - 1))


def _pieces(cps: np.ndarray, starts: np.ndarray, train: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashes of all pieces that may be segments of the text itself (training) or of texts near it (evaluation), where
    they are, and their size."""
    lengths = np.diff(starts)
    owner = owners(starts)
    at = np.arange(len(cps)) - starts[owner]
    own = [frozenset({segment_size(int(n))}) if train else _sizes_near(int(n)) for n in lengths]
    for size in sorted(set().union(*own) - {0}):
        has = np.array([size in s for s in own])
        keep = has[owner] & (at + size <= lengths[owner])
        where = np.flatnonzero(keep)
        if len(where):
            yield grams(cps, size)[where] ^ np.uint64(size << 40), where, size


def _bit(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SIEVE)).astype(np.int64)


def _has(sieve: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _bit(values)
    return (sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Known:
    """What is known of all records beforehand, in tables of fixed size: by cell, the logarithm of how often its hashes
    occur (12-grams of all, pieces of the evaluation texts), and a sieve of the hashes of each side (of the pieces of
    training texts, those that are offered)."""

    often: np.ndarray
    evaluation: np.ndarray
    training: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """Compressed, as each executor keeps what is broadcast to Python on its disk."""
        return {k: v if v is None else (len(v), pa.compress(v.tobytes(), "zstd", asbytes=True)) for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            setattr(self, k, v if v is None else np.frombuffer(pa.decompress(v[1], v[0], "zstd", asbytes=True), np.uint8))


def _logs(total: np.ndarray) -> np.ndarray:
    return np.round(8 * np.log2(1.0 + total)).astype(np.uint8)  # up to 2^31 occurrences


def chosen(cost: np.ndarray, text: np.ndarray, lengths: np.ndarray, size: int, count: np.ndarray) -> np.ndarray:
    """Of all pieces of ``size`` letters (by text and place) ``count`` disjoint ones of each text, the least in sum of
    ``cost`` if each block of a text has its share of them; which rows they are."""
    own = np.flatnonzero(np.bincount(text, minlength=len(lengths)))
    first, n, need = np.searchsorted(text, own), lengths[own], count[own]
    blocks = np.maximum(n // BLOCK, 1)
    o, j = np.repeat(np.arange(len(own)), blocks), np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    share = lambda x, j: x[o] * j // blocks[o]
    row, letters, want = first[o] + share(n, j), share(n, j + 1) - share(n, j), share(need, j + 1) - share(need, j)
    out, order = [], np.argsort(letters, kind="stable")
    for k in range(0, len(order), ASIDE):
        part = order[k : k + ASIDE]
        at, left, b = row[part], want[part], np.arange(len(part))
        width, most = int(letters[part].max()), int(left.max())
        place = np.arange(width - size + 1)[:, None]
        price = np.where(place <= letters[part] - size, cost[np.minimum(at + place, len(cost) - 1)], np.inf).astype(np.float32)
        least = np.full((width + 1, most + 1, len(part)), np.inf, np.float32)  # of so many pieces up to a letter
        least[:, 0] = 0
        for p in range(size, width + 1):
            fit = min(p // size, most)
            np.add(least[p - size, :fit], price[p - size], out=least[p, 1 : fit + 1])
            np.minimum(least[p, 1 : fit + 1], least[p - 1, 1 : fit + 1], out=least[p, 1 : fit + 1])
        free = np.full(len(part), width)
        for p in range(width, size - 1, -1):
            ends = np.flatnonzero((free >= p) & (least[p, left, b] < least[p - 1, left, b]))
            out.append(at[ends] + p - size)
            free[ends] = p - size
            left[ends] -= 1
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _segments(values: np.ndarray, text: np.ndarray, lengths: np.ndarray, size: int, shared: Known, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the pieces of training texts that are offered, and how many of each text's must be whole."""
    edits = -(-lengths // 9) - 1
    whole = np.minimum(lengths // size - edits, REPEAT)
    cost = np.where(_has(shared.evaluation, values), np.exp2(np.arange(256, dtype=np.float32) / 8)[shared.often[_cell(values, 0, bits)]], 0)
    return chosen(cost, text, lengths, size, edits + whole), whole


def known(records: DataFrame, bits: int = BITS, chunk: int = 1 << 15) -> Known:
    """Counts and sieves over all ``records`` (side, _text): of the evaluation side, then of the training side, whose
    segments are chosen by what the evaluation side has."""

    def counted(side: int, shared: Broadcast | None = None) -> tuple[np.ndarray, np.ndarray]:
        def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            table, sieve = np.zeros(1 << bits, np.int64), np.zeros(1 << SIEVE, bool)
            for batch in batches:
                for part in slices(batch, "_text"):
                    cps, starts = fold(strings(part, "_text"), marks=False)
                    values = winnow(cps, starts)[0] ^ _APART
                    table += np.bincount(_cell(values, 1, bits), minlength=len(table))
                    sieve[_bit(values)] = True
                    lengths, owner = np.diff(starts), owners(starts)
                    for values, where, size in _pieces(cps, starts, side == TRAINING):
                        if side == EVALUATION:
                            table += np.bincount(_cell(values, 0, bits), minlength=len(table))
                        else:
                            values = values[_segments(values, owner[where], lengths, size, shared.value, bits)[0]]
                        sieve[_bit(values)] = True
            return np.concatenate([table, np.packbits(sieve, bitorder="little").view(np.int64)])

        rows = spread(records.where(F.col("side") == side).select("_text"))
        total, sieve = np.split(table_sums(rows, count, (1 << bits) + (1 << (SIEVE - 6)), chunk, summed=1 << bits), [1 << bits])
        return total, sieve.view(np.uint8)

    total, evaluation = counted(EVALUATION)
    shared = records.sparkSession.sparkContext.broadcast(Known(_logs(total), evaluation))
    more, training = counted(TRAINING, shared)
    shared.destroy()
    # Pieces have the counts by which segments were chosen, so that they are chosen again.
    return Known(_logs(total + more), evaluation, training)


_HASH, _GRAM = (1 << 48) - 1, 1 << 32  # bits of a hash; what tells grams from segments


def following(cps: np.ndarray, ends: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The eight letters from ``where`` on, before ``ends``, in four bits each: 1 to 15, and 0 behind the end."""
    kind = ((cps * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(15) + np.uint32(1)
    kind = np.concatenate([kind, np.zeros(8, np.uint32)])
    out = np.zeros(len(where), np.int64)
    for i in range(8):
        out |= np.where(where + i < ends, kind[where + i], 0).astype(np.int64) << 4 * i
    return out


def goes_on(e: str, t: str) -> str:
    """SQL: whether the letters that follow on both sides, where the upper half of ``t`` has bits, differ by one edit at
    most. That may as well be where they differ first: behind it they must be the same, as they are or moved by one. (An
    edit within the four bits of one letter may hide another one there.)"""
    apart = f"(({e} ^ {t}) & shiftright({t}, 32))"
    gone = f"((shiftright({t}, 4) ^ {e}) & shiftright({t}, 36))"
    come = f"(({t} ^ shiftright({e}, 4)) & shiftright({t}, 32))"
    return f"({apart} = 0 or least(shiftright({apart}, 4), {gone}, {come}) < ({apart} & -{apart}))"


def offers(records: DataFrame, shared: Broadcast, train: bool, key: str = "_id", bits: int = BITS, share: float = SHARE) -> DataFrame:
    """What the texts of one side (``key``, cls, _text) offer, as far as the other side may have it, in few bytes: ``h``: 48
    bits of the hash, and the low 16 bits of its place; ``m``: a segment's ordinal, above it _GRAM and how many must meet
    (from bit 33 on); ``n``: letters of the text, above them the rest of the place; ``x``: the letters behind a piece, of
    training texts as many as a segment has, if there is a next one, and above them (from bit 32 on) which bits these are;
    ``key``."""
    ship(records.sparkSession)

    def made(part: pa.RecordBatch, rows: np.ndarray, values: np.ndarray, text: np.ndarray, at: np.ndarray, m: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        may = _has(shared.value.evaluation if train else shared.value.training, values)
        values, text, at, m, x = values[may], text[may], at[may], m[may], x[may]
        h = (values & np.uint64(_HASH)) | (at.astype(np.uint64) << np.uint64(48))
        whole = [pa.array(h.view(np.int64), pa.int64()), pa.array(m, pa.int64()), pa.array(lengths[text] + ((at >> 16) << 32), pa.int64()), pa.array(x), take(part, key, rows[text])]
        return pa.RecordBatch.from_arrays(whole, ["h", "m", "n", "x", key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = np.array([i for i, c in enumerate(strings(part, "cls")) if c not in seen and not seen.add(c)], np.int64)
                if not len(rows):
                    continue
                texts = strings(part, "_text")
                cps, starts = fold([texts[i] for i in rows], marks=False)
                lengths, owner = np.diff(starts), owners(starts)
                for values, where, size in _pieces(cps, starts, train):
                    text, m = owner[where], np.zeros(len(where), np.int64)
                    if train:
                        kept, whole = _segments(values, text, lengths, size, shared.value, bits)
                        values, text, where = values[kept], text[kept], where[kept]
                        m = np.arange(len(text)) - np.searchsorted(text, text) + 1 + (whole[text] << 33)
                    x = following(cps, starts[text + 1], where + size)
                    if train:
                        last = np.append(text[1:] != text[:-1], True)
                        mask = (1 << 4 * min(size, SEGMENT)) - 1
                        x = np.where(last, 0, x & mask | mask << 32)
                    yield made(part, rows, values, text, where - starts[text], m, x, lengths)
                values, text = winnow(cps, starts)
                values ^= _APART
                order = by_text(text, shared.value.often[_cell(values, 1, bits)], stable=True)  # by hash already
                values, text = values[order], text[order]
                m = np.bincount(text, minlength=len(rows))
                rank = np.arange(len(text)) - np.repeat(np.cumsum(m) - m, m)
                least = np.maximum(np.ceil(share * m).astype(np.int64), 1)
                need = np.minimum(least, MEET)
                keep = rank < (m - least + need)[text]
                values, text = values[keep], text[keep]
                yield made(part, rows, values, text, np.zeros(len(text), np.int64), _GRAM + (need[text] << 33), np.zeros(len(text), np.int64), lengths)

    kind = records.schema[key].dataType.simpleString()
    return spread(records.select(key, "cls", "_text")).mapInArrow(run, f"h bigint not null, m bigint not null, n bigint not null, x bigint not null, `{key}` {kind}")


def meetings(evaluation: DataFrame, training: DataFrame, key: str = "_id") -> DataFrame:
    """``eval_rep``, ``train_rep`` of the records whose offers meet as they must. A segment or gram that must be met k
    times counts 60 / k, so sixty are enough."""
    e, t = evaluation.withColumnRenamed(key, "eval_rep").alias("e"), training.withColumnRenamed(key, "train_rep").alias("t")
    place = lambda x: f"(shiftrightunsigned({x}.h, 48) + shiftleft(shiftright({x}.n, 32), 16))"
    letters = lambda x: f"({x}.n & 4294967295)"
    gram, need, ordinal = f"(t.m & {_GRAM}) <> 0", "shiftright({}.m, 33)", "(t.m & 4294967295)"
    shift, edits = f"({place('e')} - {place('t')})", f"((greatest({letters('e')}, {letters('t')}) - 1) div 10)"
    moved = f"abs({shift}) < {ordinal} and abs({letters('e')} - {letters('t')} - {shift}) <= {edits} + {need.format('t')} - {ordinal}"
    met = e.join(t, F.expr(f"(e.h & {_HASH}) = (t.h & {_HASH}) and (e.m & {_GRAM}) = (t.m & {_GRAM}) and ({gram} or ({moved}) and {goes_on('e.x', 't.x')})"))
    weight = F.expr(f"cast(60 div greatest({need.format('e')}, {need.format('t')}) as int)")
    return met.select("eval_rep", "train_rep", weight.alias("w")).groupBy("eval_rep", "train_rep").agg(F.sum("w").alias("w")).where("w >= 60").select("eval_rep", "train_rep")


def sieved(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows (_id, side, _text) whose key is among the 64-bit hashes ``k`` of ``asked``, and few others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(1 << SIEVE, bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))] = True
        return np.packbits(bits, bitorder="little").view(np.int64)

    shared = rows.sparkSession.sparkContext.broadcast(table_sums(asked.select("k"), mark, 1 << (SIEVE - 6), 1 << 15, summed=0).view(np.uint8))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = _has(shared.value, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return batch.filter(pa.array(keep)).select(["_id", "side", "_text"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("_id", "side", "_text"))
    return map_text(rows.select(F.xxhash64("_id").alias("k"), "_id", "side", "_text"), "_text", run, schema)


# --- comparison in full -----------------------------------------------------------------------------------------------

_PIECES = re.compile("[.!?។៕。！？\n]+|(?<=[ก-๎ກ-ໟ])[  ]+(?=[ก-๎ກ-ໟ])")


def edit_distance(a: bytes | str, b: bytes | str) -> int:
    """Levenshtein distance, bit-parallel over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if m == 0:
        return len(b)
    peq: dict = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        pv = ((mh << 1) | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return score


def folded(texts: list[str | None]) -> list[str]:
    cps, starts = fold(texts, marks=False)
    flat = cps.tobytes().decode("utf-32-le")
    return [flat[starts[i] : starts[i + 1]] for i in range(len(texts))]


def _uncovered(a: str, b: str, n: int = GRAM) -> int:
    """Letters of a that lie in no n-gram of b."""
    there = {b[i : i + n] for i in range(len(b) - n + 1)}
    free, end = 0, 0
    for i in range(len(a) - n + 1):
        if a[i : i + n] in there:
            free += max(0, i - end)
            end = i + n
    return free + max(0, len(a) - end)


def difference(a: str, b: str) -> float:
    """The part of the letters and digits of two texts that differs, in the best order of their sentences found by
    pairing equal ones, then the nearest ones."""
    return _difference(a, b, *folded([a, b]))


def _difference(a: str, b: str, fa: str, fb: str) -> float:
    whole = max(len(fa), len(fb))
    if whole == 0:
        return 1.0
    if abs(len(fa) - len(fb)) >= DIFFER * whole:
        return abs(len(fa) - len(fb)) / whole
    best = edit_distance(fa, fb)
    if best >= DIFFER * whole:
        best = min(best, max(_uncovered(fa, fb), _uncovered(fb, fa)))  # blocks that moved
    if best < DIFFER * whole:
        return best / whole
    pa_, pb_ = (Counter(p for p in folded(_PIECES.split(t)) if p) for t in (a, b))
    rest_a, rest_b = list((pa_ - pb_).elements()), list((pb_ - pa_).elements())
    holders: dict[str, set[int]] = {}  # only sentences with four letters in a row in common can be near
    for j, y in enumerate(rest_b):
        for k in range(max(1, len(y) - 3)):
            holders.setdefault(y[k : k + 4], set()).add(j)
    meet = {(i, j) for i, x in enumerate(rest_a) for k in range(max(1, len(x) - 3)) for j in holders.get(x[k : k + 4], ())}
    near = sorted((edit_distance(rest_a[i], rest_b[j]), i, j) for i, j in meet)
    used_a, used_b, cost = set(), set(), 0
    for d, i, j in near:
        if i not in used_a and j not in used_b and d < max(len(rest_a[i]), len(rest_b[j])):
            used_a.add(i)
            used_b.add(j)
            cost += d
    cost_a = sum(len(x) for i, x in enumerate(rest_a) if i not in used_a)
    cost_b = sum(len(x) for j, x in enumerate(rest_b) if j not in used_b)
    return min(best, cost + max(cost_a, cost_b)) / whole


def _containment(a: str, b: str, n: int = GRAM) -> float:
    """Part of the n-grams of a that b holds."""
    mine = {a[i : i + n] for i in range(max(1, len(a) - n + 1))}
    return len(mine & {b[i : i + n] for i in range(max(1, len(b) - n + 1))}) / len(mine)


def letter_counts(cps: np.ndarray, starts: np.ndarray, bins: int) -> np.ndarray:
    """How many letters of each of ``bins`` kinds each text has."""
    n = len(starts) - 1
    kind = (cps * np.uint32(2654435761)) >> np.uint32(16)
    return np.bincount(owners(starts) * bins + (kind % bins).astype(np.int64), minlength=n * bins).reshape(n, bins)


def may_be_near(cps: np.ndarray, starts: np.ndarray, bins: int = 128) -> np.ndarray:
    """For texts 0, 2, .. and 1, 3, .. in pairs: whether their letters, in any order, are near enough. An edit changes two
    of the numbers of letters of a kind by one."""
    many = letter_counts(cps, starts, bins)
    apart = np.abs(many[0::2] - many[1::2]).sum(axis=1)
    longer = np.maximum(*np.diff(starts).reshape(-1, 2).T)
    return apart <= 2 * ((longer - 1) // 10)


def compared(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (eval_cls, train_cls, eval_text, train_text) the near ones, with ``containment`` of the evaluation text
    in the training text and the ``difference`` of both, below DIFFER."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [t for pair in zip(strings(batch, "eval_text"), strings(batch, "train_text"), strict=True) for t in pair]
        cps, starts = fold(both, marks=False)
        keep, rows = [], []
        for i in np.flatnonzero(may_be_near(cps, starts)):
            x, y = (cps[starts[k] : starts[k + 1]].tobytes().decode("utf-32-le") for k in (2 * i, 2 * i + 1))
            d = _difference(both[2 * i], both[2 * i + 1], x, y)
            if d < DIFFER:
                keep.append(i)
                rows.append((_containment(x, y), d))
        at = np.array(keep, np.int64)
        values = np.array(rows, np.float64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([take(batch, "eval_cls", at), take(batch, "train_cls", at), pa.array(values[:, 0]), pa.array(values[:, 1])], ["eval_cls", "train_cls", "containment", "difference"])

    return map_text(pairs.select("eval_cls", "train_cls", "eval_text", "train_text"), "eval_text", run, "eval_cls binary, train_cls binary, containment double, difference double", thin=False)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def cross_split_overlaps(records: DataFrame, key: str = "rec_id", split: str = "split", text: str = "text", share: float = SHARE) -> DataFrame:
    """``eval_id``, ``train_id``, ``containment``, ``difference`` of all pairs of a training and an evaluation record
    whose texts are the same or differ in less than a tenth of their letters and digits.

    Null keys, null texts and texts without letters and digits give no pair; a record delivered again counts once; a
    split other than train, validation and test takes no part; other columns are ignored."""
    side = F.when(F.lower(F.trim(F.col(split))) == "train", TRAINING).otherwise(EVALUATION).cast("tinyint")
    rows = records.where(F.lower(F.trim(F.col(split))).isin("train", "validation", "test"))
    rows = rows.select(F.col(key).alias("_id"), side.alias("side"), F.col(text).alias("_text")).where("_id is not null and _text is not null")
    rows = rows.withColumn("cls", _digest("_text"))
    shared = rows.sparkSession.sparkContext.broadcast(known(rows))
    held, train = rows.where(F.col("side") == EVALUATION), rows.where(F.col("side") == TRAINING)
    use_checkpoints(records.sparkSession)
    met = meetings(offers(held, shared, False, share=share), offers(train, shared, True, share=share)).checkpoint()  # read twice
    shared.unpersist()  # what was checkpointed isn't worked out again
    asked = sieved(rows, met.select(F.explode(F.array(F.xxhash64("eval_rep"), F.xxhash64("train_rep"))).alias("k")))
    of = lambda kind, name: asked.where(F.col("side") == kind).select(F.col("_id").alias(f"{name}_rep"), F.col("_text").alias(f"{name}_text"))
    pairs = met.join(of(EVALUATION, "eval"), "eval_rep").join(of(TRAINING, "train"), "train_rep")
    near = compared(pairs.select(_digest("eval_text").alias("eval_cls"), _digest("train_text").alias("train_cls"), "eval_text", "train_text").where("eval_cls <> train_cls"))
    near = near.groupBy("eval_cls", "train_cls").agg(F.max("containment").alias("containment"), F.min("difference").alias("difference"))
    # From the texts that were compared to all records that hold them.
    member = lambda part, name: part.where(F.col("_text").rlike(r"[\p{L}\p{N}]")).select(F.col("_id").alias(f"{name}_id"), F.col("cls").alias(f"{name}_cls"))
    ours, theirs = member(held, "eval"), member(train, "train")
    close = near.join(ours, "eval_cls").join(theirs, "train_cls").select("eval_id", "train_id", "containment", "difference")
    same = ours.join(theirs, F.col("eval_cls") == F.col("train_cls")).select("eval_id", "train_id", F.lit(1.0).alias("containment"), F.lit(0.0).alias("difference"))
    return same.unionByName(close).groupBy("eval_id", "train_id").agg(F.max("containment").alias("containment"), F.min("difference").alias("difference"))


def overlap_report(records: DataFrame, key: str = "rec_id", split: str = "split", source: str = "source", text: str = "text") -> DataFrame:
    """Per evaluation split and source: its records that occur in training, and the pairs."""
    pairs = cross_split_overlaps(records, key, split, text)
    meta = records.groupBy(F.col(key).alias("eval_id")).agg(F.max(F.struct(split, source)).alias("m")).select("eval_id", F.col(f"m.{split}").alias("split"), F.col(f"m.{source}").alias("source"))
    return pairs.join(meta, "eval_id").groupBy("split", "source").agg(F.countDistinct("eval_id").alias("records"), F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("difference") == 0).alias("same_pairs"))
