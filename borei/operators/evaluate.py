"""Metrics, benchmark scores, grounding of n-grams, checks of model outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from borei.functions import unicode as U
from borei.operators.lexicon import Lexicon, check_texts
from borei.operators.tokenizers import clusters_of
from borei.session import ship

# --- metrics ----------------------------------------------------------------------------------------------------------


def edit_distance(reference: list, hypothesis: list) -> int:
    """Levenshtein distance of two sequences of units, one array row per unit of the reference."""
    ids: dict = {}
    a = np.array([ids.setdefault(u, len(ids)) for u in reference], np.int64)
    b = np.array([ids.setdefault(u, len(ids)) for u in hypothesis], np.int64)
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for i, unit in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != unit))
        row = np.minimum.accumulate(np.concatenate([[i], best]) - steps) + steps
    return int(row[-1])


def character_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edits of code points per code point of the reference; against an empty one 0 if both are empty, else 1."""
    r, h = (F.col(x) if isinstance(x, str) else x for x in (reference, hypothesis))
    return F.coalesce(F.try_divide(F.levenshtein(r, h), F.char_length(r)), F.when(F.char_length(r) == 0, F.when(F.char_length(h) == 0, 0.0).otherwise(1.0)))


@pandas_udf(T.DoubleType())
def _ger(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    def rate(r: str | None, h: str | None) -> float | None:
        if r is None or h is None:
            return None
        a, b = clusters_of(r), clusters_of(h)
        return edit_distance(a, b) / len(a) if a else float(bool(b))

    return pd.Series([rate(r, h) for r, h in zip(reference, hypothesis, strict=True)], dtype="float64")


def grapheme_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """The same per cluster (arrays have no built-in edit distance: Arrow batches)."""
    r, h = (F.col(x) if isinstance(x, str) else x for x in (reference, hypothesis))
    return _ger(r, h)


def exact_match(reference: Column | str, hypothesis: Column | str) -> Column:
    r, h = (F.col(x) if isinstance(x, str) else x for x in (reference, hypothesis))
    return r == h


def validity_rate(df: DataFrame, text: str = "text") -> DataFrame:
    """Share of texts without structural errors; 0 for no texts."""
    return df.agg(F.coalesce(F.avg(U.is_valid(text).cast("double")), F.lit(0.0)).alias("validity_rate"))


def error_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Structural errors by code."""
    found = df.select(F.explode(U.issues(text)).alias("i")).where("i.severity = 'error'")
    return found.groupBy(F.col("i.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def windows(stream: DataFrame, size: int) -> DataFrame:
    """Tumbling windows of a token stream (pos, id): inputs and their targets one further on; whole windows only."""
    inputs = stream.select(F.floor(F.col("pos") / size).alias("window"), "pos", "id")
    targets = stream.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("target"))
    pairs = inputs.join(targets, "pos").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "target"))).alias("w"))
    return pairs.where(F.size("w") == size).select("window", F.transform("w", lambda x: x["id"]).alias("inputs"), F.transform("w", lambda x: x["target"]).alias("targets"))


def perplexity(losses: DataFrame, loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    """exp of the token-weighted mean loss (null without tokens)."""
    mean = F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens))
    return losses.agg(F.exp(mean).alias("perplexity"), mean.alias("mean_loss"), F.sum(tokens).alias("num_tokens"))


# --- benchmark --------------------------------------------------------------------------------------------------------

# The cases that can be checked mechanically.
STRUCTURAL_CASES = [
    ("normalization", "  កម្ពុជា   ជា  ", "កម្ពុជា ជា", "collapse whitespace"),
    ("normalization", "មួយ\n\n\n\nពីរ", "មួយ\n\nពីរ", "collapse blank lines"),
    ("transliteration", "កម្ពុជា", "kâmpŭchéa", "citation romanization"),
    ("transliteration", "១២៣", "123", "Khmer digits"),
]


def structural_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STRUCTURAL_CASES, "category string, input string, expected string, note string")


def structural_prediction() -> Column:
    """What this engine answers to the structural cases."""
    return F.when(F.col("category") == "normalization", U.normalize("input")).when(F.col("category") == "transliteration", U.transliterate("input")).otherwise(F.col("input"))


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def run_benchmark(cases: DataFrame, predict: Column | Callable[[Column], Column]) -> DataFrame:
    """Each case with its prediction and scores; ``predict`` is a column over the case or a function of its input."""
    ship(cases.sparkSession)
    predicted = predict if isinstance(predict, Column) else predict(F.col("input"))
    rows = cases.withColumn("predicted", predicted)
    rows = rows.withColumn("exact", exact_match("expected", "predicted")).withColumn("cer", character_error_rate("expected", "predicted")).withColumn("ger", grapheme_error_rate("expected", "predicted"))
    rows = rows.withColumn("contains", F.contains(F.col("predicted"), U.trim_ws("expected")))
    return rows.withColumn("verdict", F.when(F.col("exact"), "exact").when(F.col("contains"), "contains").otherwise("wrong"))


def category_scores(results: DataFrame) -> DataFrame:
    """Means per category and over all (category null), in one pass."""
    return results.rollup("category").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.col("exact").cast("double")).alias("exact_match"),
        F.avg("cer").alias("cer"),
        F.avg("ger").alias("ger"),
        F.avg(F.col("contains").cast("double")).alias("contains"),
    )


def format_benchmark(results: DataFrame) -> str:
    rows = sorted(category_scores(results).collect(), key=lambda r: (r.category is None, r.category or ""))
    lines = [f"{'category':<20} {'n':>6} {'exact':>8} {'cer':>8} {'ger':>8} {'contains':>9}"]
    return "\n".join([*lines, *(f"{r.category or 'OVERALL':<20} {r.cases:>6} {r.exact_match:>8.1%} {r.cer:>8.3f} {r.ger:>8.3f} {r.contains:>9.1%}" for r in rows)])


# --- grounding --------------------------------------------------------------------------------------------------------

ORDERS = (2, 3, 4)


def _grams(df: DataFrame, text: str, orders: Iterable[int], *keep: str) -> DataFrame:
    clusters = df.where(F.col(text).isNotNull()).select(*keep, U.graphemes(text).alias("g"))
    out = None
    for n in orders:
        part = clusters.select(*keep, F.lit(n).alias("n"), F.explode(U.ngrams(F.col("g"), n, U.SEPARATOR)).alias("gram"))
        out = part if out is None else out.unionByName(part)
    return out


class Grounding:
    """The distinct n-grams of a corpus; texts are scored by a join on them."""

    def __init__(self, corpus: DataFrame, text: str = "text", orders: tuple[int, ...] = ORDERS):
        self.orders, self.index = orders, _grams(corpus, text, orders).distinct()

    def sizes(self) -> DataFrame:
        return self.index.groupBy("n").agg(F.count(F.lit(1)).alias("grams"))

    def score(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(``key``, n, total, attested, ratio): n-grams of each text, each occurrence counted, and those the corpus
        has. Occurrences are counted per text before the join."""
        grams = _grams(df, text, self.orders, key).groupBy(key, "n", "gram").agg(F.count(F.lit(1)).alias("c"))
        joined = grams.join(self.index.withColumn("hit", F.lit(1)), ["n", "gram"], "left")
        sums = joined.groupBy(key, "n").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("hit") == 1, F.col("c")).otherwise(0)).alias("attested"))
        every = df.select(key).distinct().select(key, F.explode(F.array(*map(F.lit, self.orders))).alias("n"))
        every = every.join(sums, [key, "n"], "left").select(key, "n", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("attested", F.lit(0)).alias("attested"))
        return every.withColumn("ratio", F.coalesce(F.try_divide(F.col("attested"), F.col("total")), F.lit(0.0)))

    def summary(self, df: DataFrame, key: str, text: str = "text") -> DataFrame:
        return self.score(df, key, text).groupBy(key).pivot("n", list(self.orders)).agg(F.first("ratio"))


# --- checks of outputs ------------------------------------------------------------------------------------------------

PASS, FAIL, UNAVAILABLE = "PASS", "FAIL", "UNAVAILABLE"
CHECK = "struct<name:string,status:string,detail:string,score:double>"


def khmer_share(c: Column | str) -> Column:
    """Share of Khmer among the characters that have a script: the script ratio, 0 for null."""
    return F.coalesce(U.script_ratio(c), F.lit(0.0))


def _check(name: str, status: Column | str, detail: Column | str, score: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(name).alias("name"), lit(status).alias("status"), lit(detail).alias("detail"), (score if score is not None else F.lit(None)).cast("double").alias("score")).cast(CHECK)


def analyze_outputs(df: DataFrame, key: str, text: str = "text", lexicon: Lexicon | None = None, min_khmer_ratio: float = 0.5, max_repetition: int = 5, min_spelling: float = 0.9) -> DataFrame:
    """(``key``, checks, issues, passed, coverage): seven checks of each output; those that can't be made say so."""
    ship(df.sparkSession)
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    if lexicon is not None:
        spelled = check_texts(rows.select(key, "_t"), lexicon, key, "_t").select(F.col(key).alias("_k"), "checks", "misspelled", F.col("score").alias("spelling"))
        rows = rows.join(spelled, rows[key].eqNullSafe(spelled["_k"]), "left").drop("_k")
    else:
        rows = rows.select("*", F.lit(0).alias("checks"), F.lit(0).alias("misspelled"), F.lit(None).cast("double").alias("spelling"))
    rows = rows.withColumn("issues", U.issues("_t")).withColumn("_share", khmer_share("_t")).withColumn("_run", U.longest_run("_t"))
    codes = F.transform(F.filter("issues", lambda i: i["severity"] == "error"), lambda i: i["code"])
    verdict = lambda ok: F.when(ok, PASS).otherwise(FAIL)
    spelling = F.when(F.coalesce(F.col("checks"), F.lit(0)) == 0, _check("Spelling", UNAVAILABLE, "no words to check" if lexicon is not None else "no lexicon")).otherwise(_check("Spelling", verdict(F.col("spelling") >= min_spelling), F.format_string("%d likely misspelling(s)", "misspelled"), F.col("spelling")))
    checks = F.array(
        _check("Unicode", verdict(F.size(codes) == 0), F.when(F.size(codes) == 0, "no structural errors").otherwise(F.array_join(codes, "; "))),
        _check("Khmer script", verdict(F.col("_share") >= min_khmer_ratio), F.format_string("%.0f%% of the characters of a script are Khmer", F.col("_share") * 100), F.col("_share")),
        _check("Repetition", verdict(F.col("_run") <= max_repetition), F.format_string("longest run of one cluster: %d", "_run"), F.col("_run")),
        spelling,
        _check("Grammar", UNAVAILABLE, "needs a parser"),
        _check("Meaning", UNAVAILABLE, "needs reference answers"),
        _check("Naturalness", UNAVAILABLE, "needs a reference model"),
    )
    out = rows.select(key, F.col("_t").alias(text), checks.alias("checks"), "issues")
    made = F.size(F.filter("checks", lambda c: c["status"] != UNAVAILABLE))
    return out.select("*", F.forall("checks", lambda c: c["status"] != FAIL).alias("passed"), F.format_string("%d/7 checks implemented", made).alias("coverage"))


def format_report(row) -> str:
    """A row of :func:`analyze_outputs`, as text."""
    return "\n".join([f"{c['status']:<12} {c['name']}: {c['detail']}" for c in row["checks"]] + [row["coverage"]])


# --- translation look-up ----------------------------------------------------------------------------------------------


def translate(df: DataFrame, cache: DataFrame, text: str = "text", source: str = "km", target: str = "en", out: str = "translated") -> DataFrame:
    """Left join with a table of earlier translations (source, target, text, translated, match); blank texts and texts
    that aren't there give null. ``low_confidence`` marks a match below one half."""
    known = cache.where((F.col("source") == source) & (F.col("target") == target)).select(F.col("text").alias("_key"), F.col("translated").alias(out), F.col("match"))
    rows = df.withColumn("_key", F.nullif(U.trim_ws(text), F.lit("")))
    return rows.join(known, "_key", "left").drop("_key").withColumn("low_confidence", F.col("match") < 0.5)


def round_trip(df: DataFrame, cache: DataFrame, text: str = "text", source: str = "km", via: str = "en") -> DataFrame:
    """There and back by two look-ups."""
    there = translate(df, cache, text, source, via, "there").drop("match", "low_confidence")
    return translate(there, cache, "there", via, source, "back")
