"""Problem 3: sentences of texts in all scripts, by a finite transducer run as a parallel prefix scan.

A lexer turns each text into events (marks, quotes, brackets, blank lines, spaces between Thai or Lao letters); what a
point means is told by what stands next to it, so points of abbreviations, initials, decimals and ellipses are no
events. A transducer over the events keeps which quote is open, and tells after which events a sentence may end. A long
sequence is cut in blocks; for each block its function from states to states is worked out for all states at once, the
functions are composed by a prefix scan (log-many array steps), and then all blocks run from their known first states.
How many brackets are open, whatever their number, is a prefix scan too: of running sums and their running minimum (a
closing bracket that closes nothing doesn't count). A sentence ends where both allow it. All texts of a batch are one
sequence, each begun by an event that resets everything.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import latest, lists, map_text, strings
from borei.llm.confusables import _TO_LATIN, _plain

# Abbreviations whose point never ends a sentence, and ones that may be its last word.
NEVER_LAST = "dr mr mrs ms prof st jl tp ts ths gs bs m mm mme mlle me ir bpk no nos p pp vol art fig cf approx i.e e.g ex ed rev gen hr sdr vd nr op cit al tt vs ca"
MAYBE_LAST = "etc ltd inc co corp jr sr a.m p.m v.v dll dsb dst tbk km cm kg hlm"
SAID = "asked said replied demandait disait demande dit là kata tanya ujar hỏi nói wrote"

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĀĂĐĨŨƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ", "a-zß-öø-ÿāăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
_LATIN = _UPPER + _LOWER
_TAI = "ก-ฺเ-๎ກ-ຽເ-໎ໜ-ໟ"
_LOCAL = f"ក-៓ៜ៝{_TAI}"
_SPACE = "[ \t\xa0 -  　]"
_SPACES = " \t\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
# Each alternative begins with a character or class and without a group, so the search skips along one character set.
_LEX = re.compile(
    rf"\n[{_SPACES}]*\n\s*"
    rf"|[{_SPACES}]+(?=[{_TAI}])"
    rf"|។[{_SPACES}]?ល[{_SPACES}]?។|៘"
    rf"|\.\.+|…"
    rf"|[!?។៕。！？][.!?។៕。！？]*"
    rf"|\.[!?]*"
    rf"|[«»“”\"「」『』()\[\]【】（）]"
)
_TAI_CHAR = re.compile(f"[{_TAI}]")
_BEFORE = re.compile(rf"[{_LATIN}][{_LATIN}.]*\Z")
_NEXT_NEW = re.compile(rf"\s+(?:[«“\"(]\s*[{_LATIN}]|(?P<word>[{_UPPER}][{_LATIN}']*))")
_LATIN_OR_DIGIT = re.compile(rf"[{_LATIN}\d]")
_NEXT_LOWER = re.compile(rf"{_SPACE}+[{_LOWER}]")

# Events. Quotes come as open, close, and close after a mark with a new sentence to follow.
RESET, MARK, TAI, LEFT, RIGHT = range(5)
_KINDS = {"«": 1, "»": 1, "“": 2, "”": 2, '"': 3, "「": 4, "」": 4, "『": 5, "』": 5}
OPEN, CLOSE, CLOSE_NEW, TOGGLE, TOGGLE_NEW = 5, 11, 17, 23, 24
EVENTS, QUOTES = 25, 6


@lru_cache(None)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """The transducer: next state and whether a sentence may end, by state (the open quote) and event."""
    step = np.tile(np.arange(QUOTES)[:, None], (1, EVENTS)).astype(np.int16)
    ends = np.zeros((QUOTES, EVENTS), bool)
    step[:, RESET], ends[:, RESET] = 0, True
    ends[0, [MARK, TAI]] = True
    for k in range(1, QUOTES):
        step[0, OPEN + k] = k
        step[k, [CLOSE + k, CLOSE_NEW + k]] = 0
        ends[k, CLOSE_NEW + k] = True
    step[0, [TOGGLE, TOGGLE_NEW]], step[3, [TOGGLE, TOGGLE_NEW]] = 3, 0
    ends[3, TOGGLE_NEW] = True
    return step, ends


def depths(events: np.ndarray) -> np.ndarray:
    """How many brackets are open before each event."""
    steps = (events == LEFT).astype(np.int64) - (events == RIGHT)
    steps[events == RESET] = -len(events) - 1  # below all that was open
    sums = np.cumsum(steps)
    after = sums - np.minimum(np.minimum.accumulate(sums), 0)
    return np.concatenate([[0], after[:-1]])


def run_machine(events: np.ndarray, block: int = 64) -> np.ndarray:
    """Whether a sentence ends after each event: blocks as state functions, composed by a prefix scan, outside brackets."""
    step, ends = _machine()
    n = -(-len(events) // block)
    if not n:
        return np.zeros(0, bool)
    grid = np.full(n * block, RIGHT, np.int64)
    grid[: len(events)] = events
    grid = grid.reshape(n, block)
    functions = np.tile(np.arange(len(step), dtype=np.int16), (n, 1))
    for j in range(block):
        functions = step[functions, grid[:, j : j + 1]]
    span = 1
    while span < n:
        later = functions[span:]
        functions = np.concatenate([functions[:span], np.take_along_axis(later, functions[:-span].astype(np.int64), axis=1)])
        span *= 2
    state = np.zeros(n, np.int16)
    state[1:] = functions[:-1, 0]
    out = np.zeros((n, block), bool)
    for j in range(block):
        out[:, j] = ends[state, grid[:, j]]
        state = step[state, grid[:, j]]
    return out.reshape(-1)[: len(events)] & ((depths(events) == 0) | (events == RESET))


@lru_cache(None)
def _reading() -> dict[int, str]:
    """What single characters are read as: plain forms and Latin for its look-alikes, in their case; invisible ones go."""
    return {cp: to for cp, to in _plain().items() if len(to) < 2 and cp not in (0x17A3,)} | {ord(a): b for a, b in _TO_LATIN.items()}


@lru_cache(None)
def _odd() -> re.Pattern:
    cps = sorted(cp for cp in _reading() if cp < 0x20000)
    spans, start = [], None
    for i, cp in enumerate(cps):
        start = cp if start is None else start
        if i + 1 == len(cps) or cps[i + 1] != cp + 1:
            spans.append(f"\\U{start:08x}-\\U{cp:08x}")
            start = None
    return re.compile("[" + "".join(spans) + "]")


def _read(text: str) -> tuple[str, list[int] | None]:
    """The text as it is read, and where each of its characters stands (None: where it stands)."""
    if not _odd().search(text):
        return text, None
    table, out, at = _reading(), [], []
    for i, c in enumerate(text):
        to = table.get(ord(c), c)
        if to:
            out.append(to)
            at.append(i)
    return "".join(out), at


def lex(text: str) -> list[tuple[int, int, int]]:
    """Events of a text: (event, where a sentence that it ends stops, where the next may begin)."""
    events: list[tuple[int, int, int]] = []
    cased = text != text.lower()
    for m in _LEX.finditer(text):
        a, b, c = m.start(), m.end(), text[m.start()]
        if c == "\n":
            events.append((RESET, a, b))
        elif c in "!?។៕。！？":
            if not (c == "។" and b - a > 2 and "ល" in m[0]):
                events.append((MARK, b, b))
        elif c == ".":
            if b - a > 1 and text[a + 1] == ".":
                if a and not text[a - 1].isspace() and _NEXT_NEW.match(text, b):
                    events.append((MARK, b, b))
            elif _ends_at_point(text, a, b, cased):
                events.append((MARK, b, b))
        elif c == "…":
            if a and not text[a - 1].isspace() and _NEXT_NEW.match(text, b):
                events.append((MARK, b, b))
        elif c in "([【（":
            events.append((LEFT, b, b))
        elif c in ")]】）":
            events.append((RIGHT, b, b))
        elif c in _KINDS:
            before = text[a - 1 : a]
            if before and before in " \xa0\u202f":
                before = text[a - 2 : a - 1]
            new = bool(before) and before in ".!?…" and c not in "«“「『" and _new_sentence(text, a, b)
            if c == '"':
                events.append((TOGGLE_NEW if new else TOGGLE, b, b))
            elif c in "«“「『":
                events.append((OPEN + _KINDS[c], b, b))
            else:
                events.append(((CLOSE_NEW if new else CLOSE) + _KINDS[c], b, b))
        elif c != "៘" and a and _TAI_CHAR.match(text, a - 1):
            events.append((TAI, a, b))
    return _paired(events)


def _new_sentence(text: str, a: int, b: int) -> bool:
    """Whether a new sentence follows the quote that closes at b, in a language with capital letters."""
    while a and (text[a - 1] in ".!?…" or text[a - 1].isspace()):
        a -= 1
    after = _NEXT_NEW.match(text, b)
    return bool(a and _LATIN_OR_DIGIT.match(text, a - 1) and after and (after["word"] or "").lower() not in SAID.split())


def _ends_at_point(text: str, a: int, b: int, cased: bool) -> bool:
    if b - a > 1:
        return True
    before, after = text[a - 1 : a], text[b : b + 1]
    if after.isdigit() or re.match(rf"[{_LOCAL}]", before):
        return False  # decimals, numbered names; abbreviations of scripts with marks of their own
    if after.isalpha():
        return before.islower() and after.isupper() and not _abbreviation(text, a)
    word = _abbreviation(text, a)
    if word in NEVER_LAST.split() or (len(word) == 1 and word.isalpha() and text[a - 1].isupper()):
        return False
    new = _NEXT_NEW.match(text, b)
    if word in MAYBE_LAST.split():
        return bool(new) and not (text[a - 1].isupper() and (new["word"] or "").isupper())
    return not (cased and _NEXT_LOWER.match(text, b))


def _abbreviation(text: str, a: int) -> str:
    """The word before the point at a, if it may be an abbreviation, in lower case."""
    m = _BEFORE.search(text, max(0, a - 12), a)
    if not m or (m.start() and (text[m.start() - 1].isalnum())):
        return ""
    word = m[0].lower()
    return word if word in _KNOWN or (len(word) == 1) else ""


_KNOWN = frozenset((NEVER_LAST + " " + MAYBE_LAST).split())


def _paired(events: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Without opening quotes and brackets that nothing closes before the next blank line."""
    if not events:
        return events
    drop, closers, toggles, last = set(), dict.fromkeys(range(QUOTES), 0), 0, None
    for i in range(len(events) - 1, -1, -1):
        e = events[i][0]
        if e == RESET:
            if toggles % 2:
                drop.add(last)
            closers, toggles = dict.fromkeys(range(QUOTES), 0), 0
        elif e == RIGHT:
            closers[0] += 1
        elif e == LEFT:
            if closers[0]:
                closers[0] -= 1
            else:
                drop.add(i)
        elif e in (TOGGLE, TOGGLE_NEW):
            last = i if toggles == 0 else last
            toggles += 1
        elif CLOSE < e < TOGGLE:
            closers[(e - CLOSE) % QUOTES] += 1
        elif OPEN < e < CLOSE:
            if closers[e - OPEN]:
                closers[e - OPEN] -= 1
            else:
                drop.add(i)
    if toggles % 2:
        drop.add(last)
    return [x for i, x in enumerate(events) if i not in drop] if drop else events


_WORD = re.compile(r"[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")


def sentences(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """For each text the half-open ranges of its sentences, in order."""
    read = [_read(t) if t else ("", None) for t in texts]
    flat: list[tuple[int, int, int]] = []
    first = [0]
    for text, _ in read:
        flat.append((RESET, 0, 0))
        flat.extend(lex(text))
        flat.append((RESET, len(text), len(text)))
        first.append(len(flat))
    ends = run_machine(np.fromiter((e[0] for e in flat), np.int64, len(flat)))
    out = []
    for i, (text, at) in enumerate(read):
        spans: list[tuple[int, int]] = []
        if _LETTER.search(text):
            begin = 0
            for k in np.flatnonzero(ends[first[i] + 1 : first[i + 1]]) + first[i] + 1:
                _, stop, after = flat[k]
                piece = text[begin:stop]
                if _WORD.search(piece):
                    a, b = begin + len(piece) - len(piece.lstrip()), begin + len(piece.rstrip())
                    spans.append((a, b) if at is None else (at[a], at[b - 1] + 1))
                begin = after
        out.append(spans)
    return out


def with_sentences(df: DataFrame, key: str = "id", text: str = "text", order: str = "loaded_at") -> DataFrame:
    """(``key``, ``start_pos``, ``end_pos``): a row per sentence of each record, in code points of its text as stored.

    Null texts and texts without letters give no row; a record delivered again counts once, as delivered last."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = sentences(strings(batch, "_text"))
        flat = np.array([p for spans in found for span in spans for p in span], np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(flat, np.array([2 * len(s) for s in found]), pa.int32())], [key, order, "ends"])

    own = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, order))
    found = map_text(df.select(key, order, F.col(text).alias("_text")), "_text", run, f"{own}, ends array<int>")
    rows = latest(found, [key], ["ends"], order).where(F.size("ends") > 0)
    rows = rows.select(key, "ends", F.explode(F.sequence(F.lit(0), F.size("ends") - 2, F.lit(2))).alias("i"))
    return rows.select(key, F.get("ends", F.col("i")).alias("start_pos"), F.get("ends", F.col("i") + 1).alias("end_pos"))
