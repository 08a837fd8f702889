"""Exact-size splits of documents by a seeded hash order, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that one selection step looks at on the driver, at most.
BUCKETS = 4096


def sizes(n: int, validation: float = 0.05, test: float = 0.05) -> tuple[int, int, int]:
    """Train, validation and test sizes of n documents; held-out sets get one at least where there are three."""
    if validation < 0 or test < 0 or validation + test >= 1:
        raise ValueError(f"validation ({validation}) and test ({test}) must be fractions that leave room for training data")
    v, t = int(n * validation), int(n * test)
    if n >= 3:
        v, t = (max(v, 1) if validation > 0 else 0), (max(t, 1) if test > 0 else 0)
    return n - v - t, v, t


def _cut(keys: DataFrame, rank: int) -> tuple[int, str] | None:
    """The (hash, key) with ``rank`` smaller ones: counts of buckets of hashes, then of the buckets within one, until
    what is left is small enough to sort."""
    lo, hi = -(1 << 63), 1 << 63
    part = keys
    while hi - lo > 1:
        width = max(1, -(-(hi - lo) // BUCKETS))
        bucket = F.floor((F.col("_h").cast("decimal(38,0)") - lo) / F.lit(width).cast("decimal(38,0)")).cast("long")
        counts = {r["_b"]: r["n"] for r in part.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for b in sorted(counts):
            if rank < counts[b]:
                break
            rank -= counts[b]
        else:
            return None
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width)
        part = part.where(F.col("_h").cast("decimal(38,0)").between(F.lit(lo).cast("decimal(38,0)"), F.lit(hi - 1).cast("decimal(38,0)")))
        if counts[b] <= BUCKETS:
            break
    rows = part.orderBy("_h", "_k").offset(rank).limit(1).collect()
    return (rows[0]["_h"], rows[0]["_k"]) if rows else None


def split_documents(df: DataFrame, key: str = "id", validation: float = 0.05, test: float = 0.05, seed: int = 0) -> DataFrame:
    """``df`` with ``split``: the first documents in hash order are validation, the next test, all others train.
    Sizes are exact; ``key`` must be unique."""
    h, k = F.xxhash64(F.lit(seed), F.col(key)), F.col(key).cast("string")
    keys = df.select(h.alias("_h"), k.alias("_k"))
    n = keys.count()
    _, v, t = sizes(n, validation, test)

    def before(rank: int) -> Column:
        if rank <= 0:
            return F.lit(False)
        at = _cut(keys, rank)
        return F.lit(True) if at is None else (h < F.lit(at[0])) | ((h == F.lit(at[0])) & (k < F.lit(at[1])))

    return df.withColumn("split", F.when(before(v), "validation").when(before(v + t), "test").otherwise("train"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("documents"))
