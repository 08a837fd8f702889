"""Texts folded to their letters, marks and digits, for search and comparison: case, width, composition, look-alikes
and all other characters are ignored. Folding is a table look-up over the code points of a whole batch; the few texts
with characters of other scripts or unordered marks go through :func:`consistent_form` first."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from borei.llm._text import codepoints
from borei.llm.confusables import _TO_LATIN, _plain, coeng_da, consistent_form, mark_order_doubt

_SLOW = 0xFFFFFFFF


@lru_cache(None)
def _table() -> np.ndarray:
    """By code point: what it is folded to, 0 if it is dropped, _SLOW if the text must be brought to its form first."""
    table = np.arange(0x110000, dtype=np.uint32)
    plain = _plain()
    for cp in range(0x30000):
        ch = chr(cp)
        if 0x300 <= cp < 0x370 or ch in _TO_LATIN or 0x1100 <= cp < 0x1200:
            table[cp] = _SLOW
            continue
        to = unicodedata.normalize("NFC", plain.get(cp, ch).casefold())
        to = "".join(c for c in to if unicodedata.category(c)[0] in "LNM")
        table[cp] = 0 if not to else ord(to) if len(to) == 1 else _SLOW
    table[0xE0000:0xE1000] = 0
    table[[0xEDC, 0xEDD]] = 0xEDC, 0xEDD  # written out below
    return table


@lru_cache(None)
def _is_mark() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[cp for cp in range(0x30000) if unicodedata.category(chr(cp))[0] == "M"]] = True
    return table


def _fold_one(text: str) -> np.ndarray:
    text = unicodedata.normalize("NFC", (consistent_form(text) or "").casefold())
    return np.frombuffer("".join(c for c in text if unicodedata.category(c)[0] in "LNM").encode("utf-32-le"), np.uint32)


def fold(texts: list[str | None], marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, joined, and where each begins. Null and blank texts fold to nothing."""
    cps, starts = codepoints(texts)
    to = _table()[cps]
    slow = np.zeros(len(texts) + 1, bool)
    slow[np.searchsorted(starts, np.flatnonzero(to == _SLOW), side="right") - 1] = True
    keep = to != 0
    begin = np.concatenate([[0], np.cumsum(keep)])[starts]
    out = to[keep]
    out[out == _SLOW] = 0
    out[coeng_da(out)] = 0x178F
    slow[np.searchsorted(begin, mark_order_doubt(out), side="right") - 1] = True
    slow = slow[: len(texts)]
    two = np.flatnonzero((out == 0xEDC) | (out == 0xEDD))
    if len(two):  # Lao HO NO and HO MO, with the picture of two letters
        out[two] = np.where(out[two] == 0xEDC, 0xE99, 0xEA1)
        out = np.insert(out, two, 0xEAB)
        begin = begin + np.searchsorted(two, begin)
    if slow.any():
        parts = [(_fold_one(t or "") if s else out[begin[i] : begin[i + 1]]) for i, (t, s) in enumerate(zip(texts, slow, strict=True))]
        begin[1:] = np.cumsum([len(p) for p in parts])
        out = np.concatenate(parts)
    if not marks:
        keep = ~_is_mark()[out]
        out, begin = out[keep], np.concatenate([[0], np.cumsum(keep)])[begin]
    return out, begin
