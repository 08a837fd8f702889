"""Exact and near duplicates, keeping the first of each group in the order of ``ord``.

Near duplicates are found by MinHash signatures cut in bands. Keep-first over candidates is the lexicographically first
maximal independent set of the similarity graph. Documents that share no band with another are kept at once. The
others are decided in rounds without ever listing the pairs of a bucket: each undecided document is compared with the
first undecided one of each of its buckets; one that is first in all of them is kept, one that is similar to a kept one
is dropped, and the rest go on to the next round. A round costs one comparison per document and band, however large a
bucket is, and its state is cut with a reliable checkpoint. Rounds go on until nothing is undecided.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borei.functions import unicode as U
from borei.session import ship, use_checkpoints

PRIME, NONE = (1 << 61) - 1, 0xFFFFFFFF
HASHES, BANDS, SHINGLE, THRESHOLD = 64, 8, 5, 0.8


def coefficients(hashes: int = HASHES, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash family, drawn once from the seed."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, size=hashes, dtype=np.uint64), rng.integers(0, PRIME, size=hashes, dtype=np.uint64)


def sign(items: list[str] | np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each hash over the items; products wrap at 64 bits before the prime is taken."""
    if len(items) == 0:
        return np.full(len(a), NONE, np.int64)
    x = np.array([int.from_bytes(hashlib.sha1(s.encode()).digest()[:4], "big") for s in items], np.uint64)
    return ((a[:, None] * x + b[:, None]) % np.uint64(PRIME)).min(axis=1).astype(np.int64)


def sign_batch(values: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 16_384) -> np.ndarray:
    """Signatures of many rows: ``values`` are the rows' base hashes one after the other, ``counts`` of them each."""
    out = np.full((len(counts), len(a)), NONE, np.int64)
    ends = np.cumsum(counts)
    row = 0
    while row < len(counts):
        first = ends[row] - counts[row]
        last = max(row + 1, int(np.searchsorted(ends, first + step, side="right")))
        own = np.flatnonzero(counts[row:last]) + row
        if len(own):
            x = values[first : ends[last - 1]].astype(np.uint64)
            hashed = (x[:, None] * a + b) % np.uint64(PRIME)
            out[own] = np.minimum.reduceat(hashed, ends[own] - counts[own] - first, axis=0).astype(np.int64)
        row = last
    return out


def with_signature(df: DataFrame, shingles: Column, hashes: int = HASHES, seed: int = 0) -> DataFrame:
    """``df`` with ``sig``, the MinHash signature of an array of shingles per row (null for null). The JVM makes the base
    hashes; the family is applied to whole Arrow batches, as an operator of its own: a Python function whose argument
    holds lambdas can't be evaluated where the optimizer moves it into an aggregate."""
    ship(df.sparkSession)
    base = F.transform(shingles, lambda s: F.conv(F.substring(F.sha1(s.cast("binary")), 1, 8), 16, 10).cast("bigint"))

    def run(batches):
        a, b = coefficients(hashes, seed)
        for batch in batches:
            at = batch.schema.get_field_index("_s")
            rows = batch.column(at)
            counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            sig = sign_batch(rows.flatten().to_numpy(zero_copy_only=False), counts, a, b)
            offsets = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * hashes, pa.int32(), mask=np.append(pc.is_null(rows).to_numpy(zero_copy_only=False), False))
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.ListArray.from_arrays(offsets, pa.array(sig.reshape(-1), pa.int64()))], [*(batch.schema.names[i] for i in others), "sig"])

    schema = T.StructType([*df.schema.fields, T.StructField("sig", T.ArrayType(T.LongType()))])
    return df.withColumn("_s", base).mapInArrow(run, schema)


def signatures(df: DataFrame, key: str, shingles: Column, hashes: int = HASHES, seed: int = 0) -> DataFrame:
    """(``key``, sig) of each row."""
    return with_signature(df.select(key, shingles.alias("_in")), F.col("_in"), hashes, seed).drop("_in")


def agreement(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures: an estimate of the Jaccard similarity."""
    return F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x), F.size(a))


def band_keys(sig: Column, bands: int = BANDS, hashes: int = HASHES) -> Column:
    """One 64-bit key per band."""
    rows = hashes // bands
    return F.array(*[F.xxhash64(F.lit(i), F.slice(sig, i * rows + 1, rows)) for i in range(bands)])


def exact_heads(df: DataFrame, ord: str = "ord", hash: str = "hash") -> DataFrame:
    """``hash``, ``head``, ``copies``: the first of each group of equal hashes (partial sums map-side)."""
    return df.groupBy(hash).agg(F.min(ord).alias("head"), F.count(F.lit(1)).alias("copies"))


def near_verdicts(heads: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, hashes: int = HASHES) -> DataFrame:
    """``ord``, ``kept`` for each row of ``heads`` (ord, sig), by keep-first over band candidates."""
    use_checkpoints(heads.sparkSession)
    keyed = heads.select("ord", "sig", band_keys(F.col("sig"), bands, hashes).alias("keys"))
    seats = keyed.select("ord", F.explode("keys").alias("key"))
    shared = seats.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    contested = seats.join(shared, "key").groupBy("ord").agg(F.collect_list("key").alias("keys"))
    todo = contested.join(keyed.select("ord", "sig"), "ord").checkpoint()
    dropped: DataFrame | None = None
    while not todo.isEmpty():
        member = todo.select("ord", "sig", F.explode("keys").alias("key"))
        leaders = member.groupBy("key").agg(F.min_by(F.struct("ord", "sig"), "ord").alias("lead"))
        met = member.join(leaders, "key").select("ord", F.col("lead.ord").alias("lead"), (agreement(F.col("sig"), F.col("lead.sig")) >= threshold).alias("close"))
        first = met.groupBy("ord").agg(F.min("lead").alias("least"), F.collect_set(F.when(F.col("close") & (F.col("lead") < F.col("ord")), F.col("lead"))).alias("near"))
        state = first.select("ord", "near", (F.col("least") == F.col("ord")).alias("kept")).checkpoint()
        kept = state.where("kept").select(F.col("ord").alias("lead"))
        gone = state.select("ord", F.explode("near").alias("lead")).join(kept, "lead").select("ord").distinct()
        decided = state.where("kept").select("ord").unionByName(gone)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        todo = todo.join(decided, "ord", "left_anti").checkpoint()
    verdicts = heads.select("ord")
    if dropped is None:
        return verdicts.select("ord", F.lit(True).alias("kept"))
    return verdicts.join(dropped.withColumn("gone", F.lit(True)), "ord", "left").select("ord", F.col("gone").isNull().alias("kept"))


def deduplicate(df: DataFrame, text: str = "text", ord: str = "ord", threshold: float = THRESHOLD, hashes: int = HASHES, shingle: int = SHINGLE, bands: int = BANDS, seed: int = 0, normalized: bool = False) -> DataFrame:
    """``df`` with ``duplicate``: null for kept rows, ``exact`` for copies of a kept row, ``near`` for rows similar to
    an earlier kept one and for all their copies. A threshold of 1 or more looks for exact duplicates only.

    ``ord`` must be unique and gives the order in which the first is kept."""
    ship(df.sparkSession)
    use_checkpoints(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    keys = df.select(F.col(ord).alias("_ord"), U.content_hash(body, normalized).alias("_hash"), body.alias("_t"))
    # Texts are read once, where they are: hashed and signed in one pass, and not joined before the verdicts are known.
    if threshold < 1.0:
        keys = with_signature(keys.select("_ord", "_hash", U.shingles("_t", shingle).alias("_in")), F.col("_in"), hashes, seed)
    keys = keys.drop("_t", "_in").checkpoint()
    heads = exact_heads(keys, "_ord", "_hash").select("_hash", F.col("head").alias("_head"))
    verdicts = keys.select("_ord", "_hash").join(heads, "_hash").select("_ord", "_head")
    copy = F.when(F.col("_ord") != F.col("_head"), "exact")
    if threshold < 1.0:
        firsts = keys.join(heads.select(F.col("_head").alias("_ord")), "_ord", "left_semi")
        kept = near_verdicts(firsts.select(F.col("_ord").alias("ord"), "sig"), threshold, bands, hashes)
        verdicts = verdicts.join(kept.select(F.col("ord").alias("_head"), "kept"), "_head")
        copy = F.when(~F.col("kept"), "near").otherwise(copy)
    labels = verdicts.select("_ord", copy.alias("duplicate"))
    return df.join(labels, df[ord] == labels["_ord"]).drop("_ord")
