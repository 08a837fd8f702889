"""Batch helpers: Arrow batches to code-point arrays and back. All text work here is vectorised over a slice of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.session import ship, spread

#: Bytes of text that one vectorised step takes at most (a longer single text is taken alone, whole).
SLICE_BYTES = 1_500_000


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of at most ``limit`` bytes of ``column``."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 16
    yield batch.slice(start)


def map_text(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES, thin: bool = True) -> DataFrame:
    """``fn`` over slices of rows, in Arrow; rows are spread over the cores first where the scan has too few splits
    (``thin``: ``df`` may be such a scan)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out.num_rows:
                    yield out

    return (spread(df) if thin else df).mapInArrow(run, schema)


def table_sums(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, chunk: int, fan: int = 32, summed: int | None = None) -> np.ndarray:
    """The sum of the arrays of ``size`` integers that ``count`` makes of each task's batches; what stands behind the first
    ``summed`` ones is bits, and set where any task has set them.

    A tree of tasks adds them up chunk by chunk: on each level a group is ``fan`` tasks of the level before, so what one
    group reads and holds doesn't grow with the number of tasks. Only the sum, of fixed size, reaches the driver."""
    ship(df.sparkSession)
    schema = "chunk int, task int, counts binary"

    def packed(table: np.ndarray) -> bytes:
        return pa.compress(table.tobytes(), "zstd", asbytes=True)

    def unpacked(value: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(value, 8 * chunk, "zstd", asbytes=True), np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = count(batches).astype(np.int64)
        used = [i for i in range(size // chunk) if table[i * chunk : (i + 1) * chunk].any()]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([task] * len(used), pa.int32()), pa.array([packed(table[i * chunk : (i + 1) * chunk]) for i in used], pa.binary())], ["chunk", "task", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(chunk, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([packed(total)], pa.binary())], ["chunk", "task", "counts"])

        for batch in batches:
            for c, t, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if at is not None and at != (c, t):
                    yield row()
                    total[:] = 0
                at = (c, t)
                join = np.add if summed is None or c * chunk < summed else np.bitwise_or
                join(total, unpacked(value), out=total)
        if at is not None:
            yield row()

    level, tasks = df.mapInArrow(first, schema), max(df.rdd.getNumPartitions(), 1)
    while tasks > 1:
        tasks = -(-tasks // fan)
        groups = level.select("chunk", (F.col("task") % tasks).alias("task"), "counts").repartition("chunk", "task")
        level = groups.sortWithinPartitions("chunk", "task").mapInArrow(add, schema)
    out = np.zeros(size, np.int64)  # an empty table has no tasks
    for r in level.collect():
        out[r.chunk * chunk : (r.chunk + 1) * chunk] = unpacked(bytes(r.counts))
    return out


def strings(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def take(batch: pa.RecordBatch, column: str, rows: np.ndarray) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column)).take(pa.array(rows, pa.int64()))


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint32 array, and where each begins (one entry more than texts). Null counts as empty."""
    texts = [t or "" for t in texts]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def from_codepoints(cps: np.ndarray) -> str:
    return cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def owners(starts: np.ndarray) -> np.ndarray:
    """For each position of the joined texts, the index of its text."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with ``counts[i]`` consecutive values in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of uint64 values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(cps: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of code points: entry i covers cps[i:i+n]."""
    size = len(cps) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h *= np.uint64(0x100000001B3)
        h += cps[k : k + size]
    return mix(h)


def hash_sample(df: DataFrame, column: str, rows: int) -> DataFrame:
    """The rows of the ``rows`` distinct values of ``column`` with the smallest hashes (``_h``). Only hashes are sorted;
    the rows themselves are filtered where they are. Copies of a value come along."""
    hashed = df.where(F.col(column).isNotNull()).withColumn("_h", F.xxhash64(column))
    top = hashed.select("_h").distinct().orderBy("_h").limit(rows).agg(F.max("_h").alias("m")).first().m
    return hashed.where(F.col("_h") <= F.lit(top)) if top is not None else hashed.limit(0)


def latest(df: DataFrame, keys: list[str], results: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key of rows that were delivered more than once: the result of the latest delivery (ties: the
    greatest result). Rows without a key are records of their own. Only keys and results are shuffled, never the texts,
    and they are combined map-side first."""
    best = F.max(F.struct(F.col(order), *results)).alias("_best")
    keyless = F.when(F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_keyless", keyless).groupBy(*keys, "_keyless").agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in results])
