"""Problem 7: the whole corpus encoded with a public byte-level BPE vocabulary, as a monoid tree reduction.

A piece of text is the pair (text, ids with the places where pieces of the splitting pattern begin). Every text is cut
in halves down to leaves, each is encoded, and neighbours are joined: the pattern reads
from left to right, looks no further than one character past a match and never back, so all matches of the left part
but its last ones are those of the joined text. From the last one that is sure, a window over the boundary is split
and encoded anew; it grows until one of its matches begins where a match of the right part begins. From there on both
split alike, so the right part's ids stand. The result is that of encoding the text at once, for any cut.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import lists, map_text, strings

#: Where the vocabulary files lie, and the code points of a leaf and of the first window over a boundary.
TOKENIZERS, LEAF, WINDOW = os.environ.get("BOREI_TOKENIZERS", "/opt/tokenizers"), 256, 16
#: Matches of the pattern whose ids are remembered, at most.
REMEMBERED = 1 << 18
#: The pattern that splits text before merging (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Piece:
    """Encoded text: ids, and for each match of the pattern where it begins in the text and in the ids."""

    __slots__ = ("at", "begin", "ids", "text")

    def __init__(self, text: str, begin: list[int], at: list[int], ids: list[int]):
        self.text, self.begin, self.at, self.ids = text, begin, at, ids


class Encoder:
    """A vocabulary of ranks; ``encode`` is for whole texts, ``leaf`` and ``join`` are the monoid."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = tiktoken.Encoding("borei", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def leaf(self, text: str) -> Piece:
        begin, at, ids, pos, known = [], [], [], 0, self.known
        for match in self.split.findall(text):  # every character is in a match
            begin.append(pos)
            at.append(len(ids))
            pos += len(match)
            own = known.get(match)
            if own is None:
                own = self.words.encode_ordinary(match)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[match] = own
            ids += own
        return Piece(text, begin, at, ids)

    def join(self, a: Piece, b: Piece) -> Piece:
        if not a.text or not b.text:
            return b if not a.text else a
        sure = max(len(a.begin) - 2, 0)  # the last two matches may change with what follows
        from_, size, limit = a.begin[sure], WINDOW, len(a.text)
        text = a.text + b.text
        while True:
            end = min(limit + size, len(text))
            window = self.leaf(text[from_:end])
            whole = end == len(text)
            steady = len(window.begin) if whole else max(len(window.begin) - 2, 0)
            for k in range(steady):
                here = window.begin[k] + from_ - limit
                if here >= 0:
                    r = bisect_left(b.begin, here)
                    if r < len(b.begin) and b.begin[r] == here:
                        ids = a.ids[: a.at[sure]] + window.ids[: window.at[k]]
                        shift = len(ids) - b.at[r]
                        begin = a.begin[:sure] + [x + from_ for x in window.begin[:k]] + [x + limit for x in b.begin[r:]]
                        at = a.at[:sure] + [x + a.at[sure] for x in window.at[:k]] + [x + shift for x in b.at[r:]]
                        return Piece(text, begin, at, ids + b.ids[b.at[r] :])
            if whole:
                return Piece(text, a.begin[:sure] + [x + from_ for x in window.begin], a.at[:sure] + [x + a.at[sure] for x in window.at], a.ids[: a.at[sure]] + window.ids)
            size *= 4

    def reduce(self, text: str, leaf: int = LEAF) -> Piece:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.reduce(text[:half], leaf), self.reduce(text[half:], leaf))

    def encode(self, text: str | None, leaf: int = LEAF) -> list[int]:
        return self.reduce(text, leaf).ids if text else []

    @lru_cache(1)
    def _bytes(self) -> dict[int, bytes]:
        return {i: b for b, i in self.ranks.items()}

    def decode(self, ids: list[int]) -> str:
        """Up the tree: the bytes of the halves are concatenated; characters are read at the root."""

        def up(lo: int, hi: int) -> bytes:
            if hi - lo <= 4096:
                return b"".join(self._bytes()[i] for i in ids[lo:hi])
            return up(lo, mid := (lo + hi) // 2) + up(mid, hi)

        return up(0, len(ids)).decode("utf-8")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``key`` and ``ids``, the token ids of each row's text without special tokens (text that spells one is ordinary
    text). Null and empty texts give the empty list; one row per row of the table, whatever its key."""
    name = f"{vocabulary}.tiktoken"
    df.sparkSession.sparkContext.addFile(os.path.join(folder or TOKENIZERS, name))  # executors needn't have the folder

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = encoder(SparkFiles.get(name))
        rows = [coder.encode(t, leaf) for t in strings(batch, "_text")]
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((i for r in rows for i in r), np.int32, int(counts.sum()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists(flat, counts, pa.int32())], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return map_text(df.select(key, F.col(text).alias("_text")), "_text", run, f"`{key}` {kind}, ids array<int>")
