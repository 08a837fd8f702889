import bz2
import json

import pytest
from pyspark.sql import functions as F

from borei.operators.lexicon import Lexicon
from borei.plans import analyzer
from borei.sources import io
from borei.streaming import ingest

BODY = "កម្ពុជាជាប្រទេសមួយនៅអាស៊ីអាគ្នេយ៍។ ភ្នំពេញជារាជធានីនៃព្រះរាជាណាចក្រកម្ពុជា ដែលមានប្រជាជនរស់នៅច្រើនណាស់។"
OTHER = "ទន្លេសាបជាបឹងទឹកសាបធំជាងគេនៅអាស៊ីអាគ្នេយ៍ ហើយផ្ដល់ត្រីដល់អ្នកស្រុកជាច្រើនឆ្នាំមកហើយ។"
DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">
<page><title>A</title><ns>0</ns><revision><text>'''ក''' [[ខ|គ]]</text></revision></page>
<page><title>Talk:A</title><ns>1</ns><revision><text>x</text></revision></page>
<page><title>R</title><ns>0</ns><revision><text>#REDIRECT [[A]]</text></revision></page>
<page><title>E</title><ns>0</ns><revision><text>{{only}}</text></revision></page>
<page><title>B</title><ns>0</ns><revision><text>ឃ</text></revision></page>
</mediawiki>"""


def test_documents_round_trip(spark, tmp_path):
    src = tmp_path / "in.jsonl"
    src.write_text(json.dumps({"id": "1", "text": "ក", "source": "s", "license": "CC0", "shelf": "a"}, ensure_ascii=False) + "\n\n" + json.dumps({"id": "2", "text": "x", "source": "s", "license": "", "language": "en", "quality": 0.5, "metadata": {"k": "v"}}) + "\n")
    df = io.read_documents(spark, str(src))
    rows = {r.id: r for r in df.collect()}
    assert rows["1"].domain == "general" and rows["1"].language == "km" and rows["1"].metadata == {"shelf": "a"} and rows["1"].quality is None
    assert rows["2"].quality == 0.5 and rows["2"].metadata == {"k": "v"}
    io.write_documents(df, str(tmp_path / "out"), single=True)
    text = next((tmp_path / "out").glob("*.json")).read_text()
    assert "ក" in text and '"quality":null' in text
    src.write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="missing field"):
        io.read_documents(spark, str(src)).collect()


def test_dump(spark, tmp_path):
    path = tmp_path / "dump.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    pages = io.read_pages(spark, str(path))
    assert [r.title for r in pages.orderBy("ord").collect()] == ["A", "E", "B"]
    docs = {r.id: r for r in io.pages_to_documents(pages).collect()}
    assert set(docs) == {"kmwiki_0000000", "kmwiki_0000002"} and docs["kmwiki_0000000"].text == "ក គ" and docs["kmwiki_0000002"].metadata == {"title": "B"}
    assert io.pages_to_documents(pages, limit=2).count() == 1


def test_commented_lines(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('# note\n\n{"category": " a ", "input": "x", "expected": "y"}\n')
    assert [tuple(r) for r in io.read_cases(spark, str(path)).collect()] == [("a", "x", "y", "")]
    assert io.read_cases(spark, str(tmp_path / "none.jsonl")).count() == 0
    for bad, says in (('{"category": "a", "input": "x"}', "missing field"), ('{"category": "a", "input": "x", "expected": " "}', "cannot be scored"), ("# c\n{oops", "line 2"), ('{"category": "a", "input": 3, "expected": "y"}', "must be a string")):
        path.write_text(bad + "\n")
        with pytest.raises(Exception, match=says):
            io.read_cases(spark, str(path)).collect()
    path.write_text('{"instruction": "i", "output": "o"}\n')
    assert [tuple(r) for r in io.read_instructions(spark, str(path)).collect()] == [(1, "i", "o", "")]


def test_lexicon_and_text(spark, tmp_path):
    path = tmp_path / "lex.jsonl"
    path.write_text('{"about": "header"}\n{"word": "ក", "pos": "noun", "count": 3}\n{"word": "ខ"}\n', encoding="utf-8")
    rows = {r.word: (r.pos, r["count"]) for r in io.read_lexicon(spark, str(path)).collect()}
    assert rows == {"ក": ("noun", 3), "ខ": ("unknown", 0)} and len(Lexicon(io.read_lexicon(spark, str(path)))) == 2
    io.write_lexicon(io.read_lexicon(spark, str(path)), str(tmp_path / "lex"))
    (tmp_path / "t.txt").write_text("one\ntwo\n\n \nthree\n")
    assert [r.text for r in io.read_text(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == ["one\ntwo", "three"]
    assert io.read_text(spark, str(tmp_path / "t.txt"), by_paragraph=False).count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"km|en:ក:ខ": {"translated": "k", "match": 0.8}}, ensure_ascii=False))
    row = io.read_translations(spark, str(tmp_path / "c.json")).first()
    assert (row.source, row.target, row.text, row.translated) == ("km", "en", "ក:ខ", "k")
    io.export_characters(tmp_path / "db.json")
    assert len(json.loads((tmp_path / "db.json").read_text())["consonant"]) == 35


def test_ingest_stream(spark, tmp_path):
    schema = "id string, text string, license string"
    incoming, store = tmp_path / "in", str(tmp_path / "store")
    rows = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(incoming))
    run = lambda: ingest.ingest(spark, spark.readStream.schema(schema).parquet(str(incoming)), store, str(tmp_path / "cp")).awaitTermination()
    rows(("a", BODY, "CC0"), ("b", BODY, "CC0"))
    run()
    rows(("c", BODY + " ថ្មី", "CC0"), ("d", OTHER, "CC0"), ("e", OTHER, ""))
    run()
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == ["a", "d"]
    merged = ingest.merge_corpora(spark.createDataFrame([("a", BODY, "CC0")], schema), spark.createDataFrame([("z", BODY, "CC0"), ("y", OTHER, "CC0")], schema))
    assert sorted(r.id for r in merged.collect()) == ["a", "y"]


def test_exact_stream(spark, tmp_path):
    spark.createDataFrame([("1", "ក"), ("2", "ក​"), ("3", "ខ")], "id string, text string").write.parquet(str(tmp_path / "s"))
    stream = ingest.exact_stream(spark.readStream.schema("id string, text string").parquet(str(tmp_path / "s")))
    query = stream.writeStream.format("memory").queryName("exact_rows").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select * from exact_rows").count() == 2


def test_analyzer(spark):
    df = spark.createDataFrame([(1, " កម្ពុជា។ ")], "id int, text string")
    row = analyzer.analyze(df, "id").first()
    assert row.normalized == "កម្ពុជា។" and row.is_valid and row.transliteration.startswith("kâmpŭchéa") and row.characters[0].codepoint == "U+1780"
    assert "Transliteration" in analyzer.report(row)
    words = Lexicon(spark.createDataFrame([("កម្ពុជា", "noun", 5)], "word string, pos string, count bigint"))
    out = analyzer.segment(df.select("id", F.trim("text").alias("text")), words, "id").first()
    assert out.words[0].text == "កម្ពុជា" and out.coverage == 0.5 and "statement" in analyzer.grammar_report(out)
