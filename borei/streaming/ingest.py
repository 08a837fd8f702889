"""Incremental ingest: clean each new batch, drop what the store already has, append the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from borei.functions import unicode as U
from borei.operators.dedup import BANDS, HASHES, THRESHOLD, agreement, band_keys, with_signature
from borei.plans.pipeline import run_pipeline


def _signed(df: DataFrame) -> DataFrame:
    signed = with_signature(df, U.shingles("text"))
    return signed.withColumn("hash", U.content_hash("text", normalized=True)).withColumn("keys", band_keys(F.col("sig"), BANDS, HASHES))


def new_documents(batch: DataFrame, store: DataFrame | None, key: str = "id", threshold: float = THRESHOLD) -> DataFrame:
    """The batch's documents that pass the pipeline and are no exact or near copies of stored ones. Only candidates
    that share a band with the store are compared; each new document meets a stored one once, whatever the bands."""
    fresh = _signed(run_pipeline(batch, key).documents)
    if store is None:
        return fresh
    fresh = fresh.join(store.select("hash").distinct(), "hash", "left_anti")
    bands = store.select(F.explode("keys").alias("k"), F.col("sig").alias("other")).dropDuplicates(["k", "other"])
    near = fresh.select(key, "sig", F.explode("keys").alias("k")).join(bands, "k").where(agreement(F.col("sig"), F.col("other")) >= threshold).select(key).distinct()
    return fresh.join(near, key, "left_anti")


def ingest(spark: SparkSession, source: DataFrame, store: str, checkpoint: str, key: str = "id", **trigger) -> StreamingQuery:
    """Runs a stream of documents into the parquet store, batch by batch. A batch that is run again after a failure
    replaces its own rows, so nothing is stored twice."""

    def write(batch: DataFrame, number: int) -> None:
        try:
            known = spark.read.parquet(store).where(F.col("batch") != number)
        except Exception as missing:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            known = None
        rows = new_documents(batch, known, key).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def exact_stream(stream: DataFrame, text: str = "text", time: str | None = None, delay: str = "1 day") -> DataFrame:
    """A stream without exact copies: within a watermark where a time column is given, else over all that was seen."""
    hashed = stream.withColumn("hash", U.content_hash(F.coalesce(F.col(text), F.lit(""))))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"]) if time else hashed.dropDuplicates(["hash"])


def merge_corpora(old: DataFrame, new: DataFrame, key: str = "id", **options) -> DataFrame:
    """Batch form: both corpora together through the pipeline again; stored documents come first."""
    both = old.withColumn("_ord", F.concat(F.lit("0:"), F.col(key))).unionByName(new.withColumn("_ord", F.concat(F.lit("1:"), F.col(key))), allowMissingColumns=True)
    return run_pipeline(both, "_ord", **options).documents.drop("_ord")
