"""Readers and writers: documents, dumps, commented JSON lines, lexicons, plain text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borei import chars as C
from borei.functions import unicode as U
from borei.functions.wikitext import clean_wikitext, is_redirect
from borei.session import ship

DOCUMENT = {"id": "string", "text": "string", "source": "string", "license": "string", "domain": "string", "language": "string", "quality": "double"}
REQUIRED = ("id", "text", "source", "license")
DEFAULTS = {"domain": "general", "language": "km"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and number: a running count within each file's splits would need a sort, so the position
    comes from the scan order of whole files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_number"), "line")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents. Keys that aren't columns go to ``metadata``; a line that is no JSON object or lacks a
    required key fails the read."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    bad = [F.raise_error(F.concat(F.lit(f"missing field {k}: "), F.col("value"))) for k in REQUIRED]
    need = [F.when(F.map_contains_key("m", k), F.col("m")[k]).otherwise(b.cast("string")).alias(k) for k, b in zip(REQUIRED, bad, strict=True)]
    rest = [F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(DEFAULTS.get(k))).cast(t).alias(k) for k, t in DOCUMENT.items() if k not in REQUIRED]
    nested = F.coalesce(F.from_json(F.try_element_at("m", F.lit("metadata")), "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.map_filter("m", lambda k, v: ~k.isin(*DOCUMENT, "metadata"))
    own = F.map_filter(nested, lambda k, v: ~F.map_contains_key(extra, k))
    return rows.select(*need, *rest, F.map_concat(own, extra).alias("metadata"))


def write_documents(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines, null qualities written out, Khmer unescaped; the folder is replaced."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_pages(spark: SparkSession, path: str, namespace: str = "0") -> DataFrame:
    """(title, text) of a MediaWiki dump, XML or XML.bz2: pages of the namespace with a title and a text that are no
    redirects, in dump order (``ord``). A text of white space only is read as none."""
    schema = "title string, ns string, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    rows = pages.select(F.monotonically_increasing_id().alias("ord"), U.trim_ws("title").alias("title"), U.trim_ws("ns").alias("ns"), F.col("revision.text._VALUE").alias("text"))
    return keep_pages(rows, namespace)


def keep_pages(pages: DataFrame, namespace: str = "0") -> DataFrame:
    """Pages of a namespace with title and text that are no redirects."""
    return pages.where((F.col("ns") == namespace) & (F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(F.col("text"), F.lit("")) != "") & ~is_redirect("text"))


def pages_to_documents(pages: DataFrame, limit: int | None = None, domain: str = "wikipedia") -> DataFrame:
    """Documents of pages in the order of ``ord``. Ids count the pages seen (before empty texts go), without gaps in
    what is seen: partition sizes are summed first, so numbering needs no global window."""
    ship(pages.sparkSession)
    part = pages.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).persist()
    base, total, rows = {}, 0, {r["_part"]: r["n"] for r in part.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    for p in sorted(rows):
        base[p], total = total, total + rows[p]
    offset = F.coalesce(F.try_element_at(F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))]), F.col("_part")), F.lit(0)) if base else F.lit(0)
    numbered = part.withColumn("_n", F.col("_row") + offset)
    if limit is not None:
        numbered = numbered.where(F.col("_n") < limit)
    out = numbered.select(F.format_string("kmwiki_%07d", "_n").alias("id"), clean_wikitext("text").alias("text"), F.lit("wikipedia:km").alias("source"), F.lit("CC-BY-SA-4.0").alias("license"), F.lit(domain).alias("domain"), F.lit("km").alias("language"), F.lit(None).cast("double").alias("quality"), F.create_map(F.lit("title"), F.col("title")).alias("metadata"))
    return out.where(F.char_length("text") > 0)


def read_text(spark: SparkSession, path: str, by_paragraph: bool = True, source: str = "text", license: str = "") -> DataFrame:
    """Plain text files as documents, whole or split at blank lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parts = files.select("file", F.posexplode(F.split("value", "\n\\s*\n") if by_paragraph else F.array("value")).alias("at", "text"))
    rows = parts.select(F.concat_ws("#", F.element_at(F.split("file", "/"), -1), F.lpad(F.col("at").cast("string"), 7, "0")).alias("id"), U.trim_ws("text").alias("text"))
    return rows.where("text <> ''").select("id", "text", F.lit(source).alias("source"), F.lit(license).alias("license"), F.lit("general").alias("domain"), F.lit("km").alias("language"), F.lit(None).cast("double").alias("quality"), F.create_map().cast("map<string,string>").alias("metadata"))


def _commented(spark: SparkSession, path: str) -> DataFrame | None:
    """Objects of JSON lines with comments and blank lines; None where there is no file."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        lines = _lines(spark, path).where((U.trim_ws("line") != "") & ~U.trim_ws("line").startswith("#"))
    except (AnalysisException, Py4JJavaError):
        return None
    return lines.select("file", "line_number", "line", F.try_parse_json("line").alias("v"))


def _field(name: str, needed: bool, blank: bool = True) -> Column:
    where = F.concat(F.lit("line "), F.col("line_number").cast("string"))
    value = F.try_variant_get("v", f"$.{name}", "string")
    kind = F.schema_of_variant(F.variant_get("v", f"$.{name}", "variant"))
    missing = F.raise_error(F.concat(F.lit(f"missing field {name} in "), where)).cast("string") if needed else F.lit("")
    typed = F.when(kind.isNull() | (kind == "VOID"), missing).when(kind != "STRING", F.raise_error(F.concat(F.lit(f"{name} must be a string in "), where)).cast("string")).otherwise(value)
    if not blank:
        typed = F.when(U.trim_ws(typed) == "", F.raise_error(F.concat(F.lit(f"blank {name} cannot be scored in "), where)).cast("string")).otherwise(typed)
    return F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("no JSON object in "), where)).cast("string")).otherwise(typed)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases; a bad line fails the read with its number. No file gives no cases."""
    rows = _commented(spark, path)
    if rows is None:
        return spark.createDataFrame([], "category string, input string, expected string, note string")
    return rows.select(U.trim_ws(_field("category", True, False)).alias("category"), _field("input", True).alias("input"), _field("expected", True, False).alias("expected"), _field("note", False).alias("note"))


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    """Instruction examples, in file order (``example_id``); instruction and output must not be blank."""
    rows = _commented(spark, path)
    if rows is None:
        return spark.createDataFrame([], "example_id bigint, instruction string, output string, input string")
    return rows.select(F.col("line_number").cast("bigint").alias("example_id"), _field("instruction", True, False).alias("instruction"), _field("output", True, False).alias("output"), _field("input", False).alias("input"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, pos, count) of JSON lines; records without a word (a header) are skipped."""
    rows = spark.read.schema("word string, pos string, count bigint").json(path)
    return rows.where("word is not null").select("word", F.coalesce("pos", F.lit("unknown")).alias("pos"), F.coalesce("count", F.lit(0)).alias("count"))


def write_lexicon(df: DataFrame, path: str) -> None:
    df.select("word", "pos", "count").orderBy("word").write.mode("overwrite").json(path)


def read_headwords(spark: SparkSession, path: str) -> DataFrame:
    """(ord, word, pos) of a dictionary dump; lines that are no JSON are skipped."""
    rows = spark.read.option("mode", "DROPMALFORMED").schema("word string, pos string").json(path)
    return rows.where("word is not null").select(F.monotonically_increasing_id().alias("ord"), U.trim_ws("word").alias("word"), "pos")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, text, translated, match) of a translation cache; a broken file gives none."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<translated:string,match:double>>").alias("m"))
    rows = raw.select(F.explode("m").alias("k", "v"))
    head = F.regexp_extract("k", r"^([^|]*)\|([^:]*):", 0)
    return rows.select(F.regexp_extract("k", r"^([^|]*)\|", 1).alias("source"), F.regexp_extract("k", r"^[^|]*\|([^:]*):", 1).alias("target"), F.substring("k", F.length(head) + 1, F.length("k")).alias("text"), "v.translated", "v.match")


def export_characters(path: str | Path) -> None:
    """The character database as JSON, by type."""
    names = ["codepoint", "codepoint_hex", "char", "name", "type", "series", "romanization", "romanization_o", "ipa", "ipa_o", "place", "value"]
    out: dict[str, list] = {}
    for row in C.character_records():
        out.setdefault(row[4].lower(), []).append({k: v for k, v in zip(names, row, strict=True) if v is not None})
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2))
