"""Problem 8: evaluation texts inside corpus documents, by Wu-Manber multi-pattern search.

A document leaks an item if it holds at least ``run`` folded characters in a row of the item's input. Each such run
holds one whole block of ``run // 2`` characters that begins at a multiple of that length, so the patterns are these
aligned blocks. The search keeps a shift table over hashed suffix blocks: at each position the block that ends there
tells how far the window may skip; where it tells 0, the bucket of the window's hash tells whether it is a pattern. Around
each hit all windows of ``run`` characters are looked up among those of the items and compared character by character,
so an item that repeats itself costs no more than another.

The texts of a batch are one joined stream cut into lanes that advance together, so each step is one array operation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import from_codepoints, map_text, mix, strings, take
from borei.llm.folding import fold

#: Characters of the suffix block, bits of the shift table, length of a lane.
BLOCK, BITS, LANE = 8, 20, 1024
#: Characters of the items in one broadcast table (25 MB); more are searched in further passes.
PASS_CHARS = 1_500_000


class Patterns:
    """Search tables for aligned blocks of the items."""

    def __init__(self, ids: list[int], texts: list[str | None], run: int = 60):
        self.run, self.m = run, run // 2
        self.ids = np.array(ids, np.int64)
        self.stream, starts = fold(texts)
        sizes = np.diff(starts)
        long = np.flatnonzero(sizes >= run)
        # All windows of ``run`` characters, each once per item.
        at = np.concatenate([np.arange(starts[i], starts[i + 1] - run + 1) for i in long]) if len(long) else np.zeros(0, np.int64)
        item = np.repeat(long, sizes[long] - run + 1)
        keys = self._hash_windows(self.stream, at, run)
        order = np.lexsort((item, keys))
        keys, at, item = keys[order], at[order], item[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])
        self.runs, self.run_at, self.run_item = keys[first], at[first], item[first]
        # The patterns: blocks that begin at multiples of their length, each once.
        begin = np.concatenate([np.arange(starts[i], starts[i + 1] - self.m + 1, self.m) for i in long]) if len(long) else np.zeros(0, np.int64)
        self.keys, unique = np.unique(self._hash_windows(self.stream, begin, self.m), return_index=True)
        windows = self.stream[begin[unique][:, None] + np.arange(self.m)]
        self.shift = np.full(1 << BITS, self.m - BLOCK + 1, np.uint8)
        for end in range(BLOCK, self.m + 1):
            np.minimum.at(self.shift, self._block_hash(windows[:, end - BLOCK : end]), self.m - end)

    @classmethod
    def _hash_windows(cls, cps: np.ndarray, at: np.ndarray, size: int, step: int = 50_000) -> np.ndarray:
        parts = [cls._window_hash(cps[at[i : i + step, None] + np.arange(size)]) for i in range(0, len(at), step)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    @staticmethod
    def _block_hash(windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        for k in range(BLOCK):
            h = h * np.uint64(0x100000001B3) + windows[:, k]
        return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)

    @staticmethod
    def _stream_blocks(cps: np.ndarray) -> np.ndarray:
        """Entry i: hash of the block that ends at i (entries before the first full block count as no block)."""
        h = np.zeros(len(cps) - BLOCK + 1, np.uint64)
        for k in range(BLOCK):
            h *= np.uint64(0x100000001B3)
            h += cps[k : k + len(h)]
        return np.concatenate([np.zeros(BLOCK - 1, np.int64), (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)])

    @staticmethod
    def _window_hash(windows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        for k in range(windows.shape[1]):
            h = h * np.uint64(0x9E3779B185EBCA87) + windows[:, k]
        return mix(h)

    def search(self, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) index pairs, each once: the texts that hold ``run`` characters in a row of the items."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.keys) or len(cps) < self.run:
            return none
        shift = self.shift[self._stream_blocks(cps)].astype(np.int64)
        pos = np.arange(self.m - 1, len(cps), LANE, dtype=np.int64)
        last = np.minimum(pos + LANE, len(cps))
        found = []
        while len(pos):
            skip = shift[pos]
            hit = skip == 0
            if hit.any():
                found.append(pos[hit])
            pos = pos + np.maximum(skip, 1)
            live = pos < last
            if not live.all():
                pos, last = pos[live], last[live]
        if not found:
            return none
        begin = np.concatenate(found) - self.m + 1
        keys = self._hash_windows(cps, begin, self.m)
        begin = begin[self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys]
        if not len(begin):
            return none
        text = np.searchsorted(starts, begin, side="right") - 1
        lo, hi = np.maximum(starts[text], begin + self.m - self.run), np.minimum(begin, starts[text + 1] - self.run)
        count = np.maximum(hi - lo + 1, 0)
        at = np.unique(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count))
        keys = self._hash_windows(cps, at, self.run)
        left, right = np.searchsorted(self.runs, keys), np.searchsorted(self.runs, keys, side="right")
        times = right - left
        slot = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(left, times)
        at = np.repeat(at, times)
        text, item = np.searchsorted(starts, at, side="right") - 1, self.run_item[slot]
        pairs, one = np.unique(np.stack([text, item], axis=1), axis=0, return_index=True)
        reach = np.arange(self.run)
        same = (cps[at[one][:, None] + reach] == self.stream[self.run_at[slot[one]][:, None] + reach]).all(axis=1)
        return pairs[same, 0], pairs[same, 1]


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "input", run: int = 60, chars: int = PASS_CHARS) -> DataFrame:
    """(``key``, ``item_key``) for each document with at least ``run`` letters, marks and digits in a row of an item.

    The items are a held-out set of bounded size: they are broadcast in tables of at most ``chars`` characters, and a
    larger set is searched in several passes over the documents; a longer item is cut in parts that overlap. Null, blank and short texts on either side give no
    row; a document or item key that occurs twice gives its pairs once per row of the documents (once only if there is more than one pass)."""
    spark = docs.sparkSession
    rows = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").dropDuplicates().orderBy("i", "t")
    pairs = None
    local = rows.toLocalIterator()
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` bigint"
    slim = docs.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull())

    def parts():
        for row in local:
            if len(row.t) <= chars:
                yield row.i, row.t
            else:
                whole = from_codepoints(fold([row.t])[0])
                for at in range(0, max(len(whole) - run + 1, 0), chars):
                    yield row.i, whole[at : at + chars + run - 1]

    def passes():
        part, size = [], 0
        for item, t in parts():
            if part and size + len(t) > chars:
                yield part
                part, size = [], 0
            part.append((item, t))
            size += len(t)
        if part:
            yield part

    count = 0
    for part in passes():
        count += 1
        tables = spark.sparkContext.broadcast(Patterns(*map(list, zip(*part, strict=True)), run))

        def run_batch(batch: pa.RecordBatch, tables=tables) -> pa.RecordBatch:
            patterns = tables.value
            doc, item = patterns.search(*fold(strings(batch, "_text")))
            return pa.RecordBatch.from_arrays([take(batch, key, doc), pa.array(patterns.ids[item], pa.int64())], [key, item_key])

        found = map_text(slim, "_text", run_batch, schema)
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return spark.createDataFrame([], schema)
    return pairs if count < 2 else pairs.distinct()  # parts of an item may meet a document more than once
