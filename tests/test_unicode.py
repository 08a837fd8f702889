import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from borei import chars as C
from borei.functions import unicode as U

ALPHABET = "កខ្្ាិ់​‌‍៞ \t\n .!។aéៈṃ́"


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def randoms(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 24))) for _ in range(n)]


def attaches(ch):
    cp = ord(ch)
    if 0x1780 <= cp < 0x1800:
        return C.classify_codepoint(ch) in C.ATTACHING
    return ch in "‌‍" or unicodedata.combining(ch) != 0


def brute_clusters(text):
    """Straight from the definition: a character joins if it attaches, or is a consonant right after COENG."""
    out = []
    kinds = C.classify(text)
    for ch, kind in zip(text, kinds, strict=True):
        if out and (attaches(ch) or kind == "SUBSCRIPT_CONSONANT"):
            out[-1] += ch
        else:
            out.append(ch)
    return out


def test_golden_clusters(spark):
    got = one(spark, U.graphemes("t"), "កម្ពុជា", "ស្ត្រី", "ក​ខ", "ក្‌រ", "é", "", None)
    assert got == [["ក", "ម្ពុ", "ជា"], ["ស្ត្រី"], ["ក", "​", "ខ"], ["ក្‌រ"], ["é"], [], None]


def test_clusters_equal_brute_force(spark):
    texts = randoms()
    assert one(spark, U.graphemes("t"), *texts) == [brute_clusters(t) for t in texts]
    assert [[x for x, _, _ in U.python_pieces(t, C.KCC)] for t in texts] == [brute_clusters(t) for t in texts]


def test_positions(spark):
    spans = one(spark, U.grapheme_spans("t"), "កម្ពុជា")[0]
    assert [(s["text"], s["start"], s["end"]) for s in spans] == [("ក", 0, 1), ("ម្ពុ", 1, 5), ("ជា", 5, 7)]


def test_character_types(spark):
    want = ["CONSONANT", "CONSONANT", "COENG", "SUBSCRIPT_CONSONANT", "DEPENDENT_VOWEL", "CONSONANT", "DEPENDENT_VOWEL"]
    assert one(spark, U.char_types("t"), "កម្ពុជា") == [want] and C.classify("កម្ពុជា") == want
    texts = randoms(100, 2)
    assert one(spark, U.char_types("t"), *texts) == [C.classify(t) for t in texts]


def test_transliteration(spark):
    assert one(spark, U.transliterate("t"), "កម្ពុជា", "១២៣", "ន", "ន៍", "abc", None) == ["kâmpŭchéa", "123", "nô", "n", "abc", None]


def brute_normal(t):
    t = unicodedata.normalize("NFC", t)
    for p, r in (("​{2,}", "​"), ("​([ \t\n])", r"\1"), ("([ \t\n])​", r"\1"), ("[ \t]+", " "), ("\n{3,}", "\n\n")):
        t = re.sub(p, r, t)
    return "\n".join(x.rstrip() for x in t.split("\n")).strip()


def test_normalize(spark):
    texts = ["  កម្ពុជា   ជា  ", "a\n\n\n\nb", "ក​​​ខ", "ក​ ខ", *randoms(200, 3)]
    assert one(spark, U.normalize("t"), *texts) == [brute_normal(t) for t in texts]
    assert one(spark, U.strip_zero_width("t"), "ក​ខ‌គ‍") == ["កខគ"]


def test_sentences_and_words(spark):
    assert one(spark, U.sentences("t"), "Hello! How are you?", "មួយ។។ ពីរ", "", "  ") == [["Hello!", "How are you?"], ["មួយ។។", "ពីរ"], [], []]
    assert one(spark, U.words("t"), "កម្ពុជា ជាប្រទេស", "កម្ពុជាជា") == [["កម្ពុជា", "ជាប្រទេស"], ["កម្ពុជាជា"]]
    spans = one(spark, U.sentence_spans("t"), "ក។ ខ។")[0]
    assert [(s["text"], s["start"], s["end"]) for s in spans] == [("ក។", 0, 2), ("ខ។", 2, 5)]


@pytest.mark.parametrize(("text", "codes"), [("ា", ["orphan-combining-mark"]), ("ក្", ["coeng-no-consonant"]), ("ក្្រ", ["coeng-no-consonant"]), ("៞", ["unassigned-codepoint"]), ("ឝ", ["obsolete-consonant"]), ("ឣ", ["legacy-independent-vowel"]), ("កាិ", ["multiple-vowel-signs"]), ("ក៉៊", ["multiple-register-shifters"]), ("កម្ពុជា", [])])
def test_validation(spark, text, codes):
    assert [i["code"] for i in one(spark, U.issues("t"), text)[0]] == codes


def test_error_count_equals_issues(spark):
    texts = randoms(200, 4)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    errors = F.size(F.filter(U.issues("t"), lambda i: i["severity"] == "error"))
    assert df.where(errors != U.error_count("t")).count() == 0


def test_script_ratio(spark):
    assert one(spark, U.script_ratio("t"), "កម្ពុជា", "English", "កម្ពុជា, 2026! (…)", "", None) == [1.0, 0.0, 1.0, 0.0, None]


def test_quality(spark):
    good, english, empty = one(spark, U.quality("t"), "កម្ពុជា " * 80, "Plain English text here.", "")
    assert good["components"]["repetition"] < 0.05 and good["components"]["script"] == 1.0 and good["score"] < 0.4
    assert english["components"]["script"] == 0 and english["components"]["unicode"] == 1 and english["score"] == 0
    assert empty["score"] == 0
    assert one(spark, U.markup_score("t"), "<b>x</b>", "") == [pytest.approx(1 - 7 / 8), 1.0]


def test_prompt_helper_and_report(spark):
    from borei.session import on_texts

    assert on_texts(U.transliterate("text"), "ន", None) == ["nô", None]
    assert "script" in U.format_quality(on_texts(U.quality("text"), "កម្ពុជា")[0])


def test_shingles_and_jaccard(spark):
    assert one(spark, U.shingles("t", 2), "កម្ពុជា", "ក", "") == [["កម្ពុ", "ម្ពុជា"], ["ក"], []]
    pair = lambda a, b: one(spark, U.jaccard(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")), "x")[0]
    assert (pair("a", "a"), pair("a", "b"), pair("", ""), pair("a", "")) == (1.0, 0.0, 1.0, 0.0)


def test_runs_and_diversity(spark):
    assert one(spark, U.longest_run("t"), "ក" * 20, "", "កខ") == [20, 0, 1]
    assert one(spark, U.distinct_n("t", 2), "", "ក") == [0.0, 0.0] and one(spark, U.distinct_n("t", 1), "កខគឃង") == [1.0]


def test_clusters_taken_apart(spark):
    k = one(spark, U.clusters("t"), "ស្ត្រីំ")[0][0]
    assert (k["base"], k["subscripts"], k["vowel"], k["diacritics"], k["register_shifter"]) == ("ស", ["ត", "រ"], "ី", ["ំ"], None)


def test_character_database(spark):
    rows = {r.char: r for r in C.characters(spark).collect()}
    assert len(rows) == 35 + 17 + 2 + 16 + 24 + 10 + 10
    assert rows["ក"].romanization == "k" and rows["៣"].value == 3 and rows["ា"].romanization_o == "éa"
