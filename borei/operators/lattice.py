"""Paths through the pieces of texts, for whole batches: the likeliest one, and expected counts over all.

A text is cut in units (clusters). A piece is a run of units with a known score; it is found by a polynomial hash of its
code points, which for any run is a difference of two running sums, so all runs of one length in all texts are looked up
in one array step. The recurrences then go over the unit positions once, for all texts of a block side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Scores of runs that one block holds at most (a longer text is a block of its own).
BLOCK = 1 << 21


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Pieces:
    """Known pieces and their scores. A single unit that isn't known scores ``unknown``; a longer run isn't a piece."""

    def __init__(self, scores: dict[str, float], longest: int, unknown: float):
        self.longest, self.unknown = longest, unknown
        names = [n for n in scores if n]
        flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        ends = np.cumsum([len(n) for n in names], dtype=np.int64)
        at = np.arange(len(flat)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
        weighted = np.concatenate([[np.uint64(0)], np.cumsum((flat + np.uint64(1)) * _powers(_BASE, max(len(flat), 1))[at], dtype=np.uint64)]) if names else np.zeros(1, np.uint64)
        keys = weighted[ends] - weighted[ends - np.diff(ends, prepend=0)] if names else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.values, self.order = keys[order], np.array([scores[n] for n in names])[order], order
        self.names = names

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by text, end and length less one (minus infinity: no piece), and which piece each is (-1: none)."""
        sizes = np.array([len(t) for t in texts])
        flat = [u for t in texts for u in t]
        cps = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        edge = np.concatenate([[0], np.cumsum([len(u) for u in flat], dtype=np.int64)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum((cps + np.uint64(1)) * _powers(_BASE, len(cps))[:-1], dtype=np.uint64)])[edge]
        back = _powers(_INVERSE, len(cps))[edge]
        row = np.repeat(np.arange(len(texts)), sizes)
        end = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        shape = (len(texts), int(sizes.max(initial=0)) + 1, self.longest)
        score, which = np.full(shape, -np.inf), np.full(shape, -1, np.int64)
        for length in range(1, self.longest + 1):
            at = np.flatnonzero(end >= length)
            key = (sums[at + 1] - sums[at + 1 - length]) * back[at + 1 - length]
            slot = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            hit = self.keys[slot] == key if len(self.keys) else np.zeros(len(at), bool)
            own = np.where(hit, self.values[slot] if len(self.keys) else 0.0, self.unknown if length == 1 else -np.inf)
            score[row[at], end[at], length - 1] = own
            which[row[at], end[at], length - 1] = np.where(hit, slot, -1)
        return score, which

    def _blocks(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """Indices of texts of about one length, as many as a block holds."""
        order = np.argsort([len(t) for t in texts], kind="stable")
        begin = 0
        for i in range(len(order)):
            if i > begin and (i + 1 - begin) * (len(texts[order[i]]) + 1) * self.longest > BLOCK:
                yield order[begin:i]
                begin = i
        if begin < len(order):
            yield order[begin:]

    def best(self, texts: list[list[str]]) -> list[list[str]]:
        """The likeliest path of each text; of equal ones, the one whose last piece begins first."""
        out: list[list[str]] = [[] for _ in texts]
        for block in self._blocks(texts):
            score, _ = self.scores([texts[i] for i in block])
            top, length = np.full(score.shape[:2], -np.inf), np.zeros(score.shape[:2], np.int64)
            top[:, 0] = 0.0
            for end in range(1, score.shape[1]):
                reach = min(self.longest, end)
                ways = top[:, end - reach : end] + score[:, end, :reach][:, ::-1]  # the longest piece first
                take = ways.argmax(axis=1)
                top[:, end] = ways[np.arange(len(block)), take]
                length[:, end] = reach - take
            for lane, i in enumerate(block):
                units, path, end = texts[i], [], len(texts[i])
                while end:
                    begin = end - int(length[lane, end])
                    path.append("".join(units[begin:end]))
                    end = begin
                out[i] = path[::-1]
        return out

    def expected(self, texts: list[list[str]], times: np.ndarray) -> tuple[dict[str, float], float]:
        """Expected counts of pieces (and of unknown single units) over all paths of all texts, each text counted
        ``times``, and the log-likelihood."""
        counts, likelihood = np.zeros(len(self.keys)), 0.0
        single: dict[str, float] = {}
        for block in self._blocks(texts):
            own = [texts[i] for i in block]
            score, which = self.scores(own)
            lanes, ends = np.arange(len(block)), np.array([len(t) for t in own])
            ahead, behind = np.full(score.shape[:2], -np.inf), np.full(score.shape[:2], -np.inf)
            ahead[:, 0], behind[lanes, ends] = 0.0, 0.0
            with np.errstate(invalid="ignore", divide="ignore"):
                for end in range(1, score.shape[1]):
                    reach = min(self.longest, end)
                    ahead[:, end] = _logsum(ahead[:, end - reach : end] + score[:, end, :reach][:, ::-1])
                for begin in range(score.shape[1] - 2, -1, -1):
                    reach = min(self.longest, score.shape[1] - 1 - begin)
                    to = begin + 1 + np.arange(reach)
                    ways = behind[:, to] + score[:, to, np.arange(reach)]
                    behind[:, begin] = np.where(begin < ends, _logsum(ways), behind[:, begin])
                total = ahead[lanes, ends]
                for length in range(1, min(self.longest, score.shape[1] - 1) + 1):
                    part = np.exp(ahead[:, :-length] + score[:, length:, length - 1] + behind[:, length:] - total[:, None]) * times[block][:, None]
                    part[~np.isfinite(part)] = 0.0
                    slot = which[:, length:, length - 1]
                    counts += np.bincount(slot[slot >= 0], part[slot >= 0], minlength=len(counts))
                    if length == 1:
                        for lane, end in zip(*np.nonzero((slot < 0) & (part > 0)), strict=True):
                            unit = own[lane][end]
                            single[unit] = single.get(unit, 0.0) + part[lane, end]
            likelihood += float((np.where(np.isfinite(total), total, 0.0) * times[block]).sum())
        found = {self.names[self.order[k]]: float(counts[k]) for k in np.flatnonzero(counts)}
        return found | single, likelihood


def _logsum(ways: np.ndarray) -> np.ndarray:
    top = ways.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    return np.where(np.isfinite(top), safe + np.log(np.exp(ways - safe[:, None]).sum(axis=1)), -np.inf)
