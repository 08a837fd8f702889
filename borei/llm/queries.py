"""The queries of the nine problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borei.llm._text import latest
from borei.llm.confusables import look_alike_pairs
from borei.llm.encode import with_token_ids
from borei.llm.langid import fit_model, mislabelled_segments, with_languages
from borei.llm.leaks import leaked_items
from borei.llm.markup import fit_tree_model, with_clean_text, with_elements
from borei.llm.overlap import cross_split_overlaps, overlap_report
from borei.llm.pairs import fit_ends, with_defects
from borei.llm.sentences import with_sentences
from borei.llm.spam import fit_trees, spam_pages
from borei.session import read_table


def _model(spark: SparkSession, folder: str):
    return fit_model(read_table(spark, folder, "lang_sample", "lang", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "corpus_document", "id", "text", "language", "loaded_at")
    return mislabelled_segments(docs, _model(spark, folder))


def p1_languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "corpus_document", "id", "text", "loaded_at")
    found = with_languages(docs, _model(spark, folder), carry=("loaded_at",))
    return latest(found, ["id"], ["lang", "confidence", "segments"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        look_alike_pairs(read_table(spark, folder, name, key, "text"), key).select(F.lit(name).alias("tbl"), "a", "b")
        for name, key in (("corpus_document", "id"), ("wiki_page", "page_id"))
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return with_sentences(read_table(spark, folder, "corpus_document", "id", "text", "loaded_at"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = read_table(spark, folder, "instruction_example", "example_id", "instruction", "input", "output", "loaded_at")
    return with_defects(pairs, _model(spark, folder), fit_ends(pairs.select(F.col("input").alias("text"))))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = cross_split_overlaps(read_table(spark, folder, "corpus_split", "rec_id", "split", "text"))
    return pairs.select(F.least("eval_id", "train_id").alias("a"), F.greatest("eval_id", "train_id").alias("b"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(read_table(spark, folder, "corpus_split", "rec_id", "split", "source", "text"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "wiki_page", "page_id", "title", "text", "loaded_at")
    return with_elements(pages, fit_tree_model(pages))


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "wiki_page", "page_id", "text", "loaded_at")
    return latest(with_clean_text(pages, fit_tree_model(pages), carry=("loaded_at",)), ["page_id"], ["markup", "clean"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return with_token_ids(read_table(spark, folder, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(read_table(spark, folder, "documents", "doc_id", "text"), read_table(spark, folder, "benchmark_case", "item_id", "input"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "documents", "doc_id", "text", "source")
    return spam_pages(pages, fit_trees(pages)).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_languages, p2_found, p3_found, p4_found, p5_found, p5_report, p6_found, p6_clean, p7_ids, p8_found, p9_found)}
#: None of these can be expressed in SQL over whole tables; tests/llm holds them against brute force and round trips.
ORACLES: dict[str, str] = {}
