"""Everything the Unicode engine says of a text, as one projection, and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.functions import unicode as U
from borei.operators import grammar, lexicon


def analyze(df: DataFrame, key: str, text: str = "text", normalize: bool = True) -> DataFrame:
    """``key`` and: original, normalized, characters with types, graphemes, clusters, sentences, words, issues,
    transliteration, is_valid."""
    rows = df.select(key, F.col(text).alias("original"), (U.normalize(text) if normalize else F.col(text)).alias("normalized"))
    n = F.col("normalized")
    kinds = F.transform(F.arrays_zip(U.characters(n).alias("char"), U.char_types(n).alias("type")), lambda z: F.struct(z["char"].alias("char"), F.format_string("U+%04X", F.ascii(z["char"])).alias("codepoint"), z["type"].alias("type")))
    out = rows.select(key, "original", "normalized", kinds.alias("characters"), U.graphemes(n).alias("graphemes"), U.clusters(n).alias("clusters"), U.sentences(n).alias("sentences"), U.words(n).alias("words"), U.issues(n).alias("issues"), U.transliterate(n).alias("transliteration"))
    return out.withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def report(row) -> str:
    lines = [f"Original:        {row.original}", f"Normalized:      {row.normalized}", f"Clusters:        {' | '.join(row.graphemes or [])}", f"Words:           {' | '.join(row.words or [])}", f"Transliteration: {row.transliteration}", f"Valid:           {row.is_valid}"]
    return "\n".join(lines + [f"  {i.severity} at {i.index}: {i.code}" for i in row.issues or []])


def segment(df: DataFrame, words: lexicon.Lexicon, key: str, text: str = "text") -> DataFrame:
    """A row per sentence: its words with parts of speech, how many the lexicon has, and its grammar."""
    rows = df.select(key, F.posexplode(U.sentences(text)).alias("pos", "sentence"))
    rows = rows.withColumn("words", lexicon.Segmenter(words).words("sentence")).withColumn("matches", grammar.analyze("sentence"))
    return rows.select(key, "pos", "sentence", "words", lexicon.coverage(F.col("words")).alias("coverage"), grammar.features(F.col("sentence"), F.col("matches")).alias("f")).select(key, "pos", "sentence", "words", "coverage", "f.*")


def grammar_report(row) -> str:
    return f"{row.sentence}\n  {'question' if row.is_question else 'statement'}{' (negated)' if row.is_negated else ''}\n  tense: {row.tense}  aspect: {row.aspect}\n  confidence: {row.confidence:.2f}"
