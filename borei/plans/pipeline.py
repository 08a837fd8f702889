"""The corpus pipeline: license, normal form, duplicates, language, length, quality. The first reason to drop wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.functions import unicode as U
from borei.operators.dedup import deduplicate
from borei.session import ship

REASONS = ("missing_license", "exact_duplicate", "near_duplicate", "wrong_language", "too_short", "low_quality")


@dataclass
class PipelineResult:
    """``verdicts``: every document with its ``drop_reason`` (null if it is kept), normalized text and quality."""

    verdicts: DataFrame

    @property
    def documents(self) -> DataFrame:
        return self.verdicts.where("drop_reason is null").drop("drop_reason")

    @property
    def dropped_reasons(self) -> DataFrame:
        return self.verdicts.where("drop_reason is not null").groupBy("drop_reason").agg(F.count(F.lit(1)).alias("documents"))

    @property
    def stats(self) -> DataFrame:
        """One row: input, a count per reason, output."""
        reason = F.col("drop_reason")
        counts = [F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in REASONS]
        return self.verdicts.agg(F.count(F.lit(1)).alias("input"), *counts, F.count_if(reason.isNull()).alias("output"))

    def report(self) -> str:
        row = self.stats.first().asDict()
        return "\n".join(f"{name:<18} {count:>12}" for name, count in row.items())


def run_pipeline(df: DataFrame, key: str = "id", text: str = "text", license: str = "license", min_quality: float = 0.6, min_khmer_ratio: float = 0.5, min_graphemes: int = 20, near_duplicate_threshold: float = 0.8, require_license: bool = True) -> PipelineResult:
    """Runs all stages over ``df``. Documents are kept first in the order of ``key`` (unique); language, length and
    quality are judged after duplicates, so a document they drop may have removed its near copies before."""
    ship(df.sparkSession)
    rows = df.withColumn("_licensed", F.lit(True) if not require_license else U.trim_ws(F.coalesce(F.col(license), F.lit(""))) != "")
    rows = rows.withColumn(text, U.normalize(F.coalesce(F.col(text), F.lit(""))))
    # Measured before duplicates are known, where the texts are: each once, in a projection of its own.
    rows = rows.withColumns({"_ratio": U.script_ratio(text), "_clusters": F.size(U.graphemes(text)), "_score": U.quality_score(text)})
    unlicensed = rows.where("not _licensed").withColumn("drop_reason", F.lit("missing_license")).withColumn("quality", F.lit(None).cast("double"))
    left = deduplicate(rows.where("_licensed"), text, key, near_duplicate_threshold, normalized=False)
    reason = (
        F.when(F.col("duplicate") == "exact", "exact_duplicate")
        .when(F.col("duplicate") == "near", "near_duplicate")
        .when(F.col("_ratio") < min_khmer_ratio, "wrong_language")
        .when(F.col("_clusters") < min_graphemes, "too_short")
        .when(F.col("_score") < min_quality, "low_quality")
    )
    judged = left.withColumn("drop_reason", reason).withColumn("quality", F.when(F.col("drop_reason").isNull(), F.bround("_score", 4))).drop("duplicate", "_ratio", "_clusters", "_score")
    return PipelineResult(judged.unionByName(unlicensed.select(*judged.columns)).drop("_licensed"))


def to_sentences(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """A row per sentence of each document."""
    return df.select(*keep, F.posexplode(U.sentences(text)).alias("pos", "sentence"))
