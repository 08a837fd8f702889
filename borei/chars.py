"""The Khmer block: fixed character facts, types of code points, and the regex classes built from them.

All classes are spelled with code points (``\\x{17D2}``), which Java and RE2 read alike, so one pattern serves Spark
and its SQL check.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Fixed values. Consonants U+1780-17A2 in order: name, series, romanization, IPA.
CONSONANTS = [
    ("KA", "a", "k", "k"), ("KHA", "a", "kh", "kʰ"), ("KO", "o", "k", "k"), ("KHO", "o", "kh", "kʰ"), ("NGO", "o", "ng", "ŋ"),
    ("CA", "a", "ch", "c"), ("CHA", "a", "chh", "cʰ"), ("CO", "o", "ch", "c"), ("CHO", "o", "chh", "cʰ"), ("NYO", "o", "nh", "ɲ"),
    ("DA", "a", "d", "ɗ"), ("TTHA", "a", "th", "tʰ"), ("DO", "o", "d", "ɗ"), ("TTHO", "o", "th", "tʰ"), ("NNO", "a", "n", "n"),
    ("TA", "a", "t", "t"), ("THA", "a", "th", "tʰ"), ("TO", "o", "t", "t"), ("THO", "o", "th", "tʰ"), ("NO", "o", "n", "n"),
    ("BA", "a", "b/p", "ɓ/p"), ("PHA", "a", "ph", "pʰ"), ("PO", "o", "p", "p"), ("PHO", "o", "ph", "pʰ"), ("MO", "o", "m", "m"),
    ("YO", "o", "y", "j"), ("RO", "o", "r", "r"), ("LO", "o", "l", "l"), ("VO", "o", "v", "ʋ"), ("SHA", "a", "ś", "ɕ"),
    ("SSO", "a", "ṣ", "ʂ"), ("SA", "a", "s", "s"), ("HA", "a", "h", "h"), ("LA", "o", "l", "l"), ("QA", "a", "'", "ʔ"),
]
# Fixed values. Independent vowels U+17A3-17B3: name, romanization (none where it isn't settled), IPA.
INDEPENDENT_VOWELS = [
    ("QAQ", None, None), ("QAA", None, None), ("QI", "ĕ", "ʔə~ʔɨ~ʔəj"), ("QII", "ei", "ʔəj"), ("QU", "ŏ/ŭ", "ʔo~ʔu~ʔao"),
    ("QUK", None, None), ("QUU", None, None), ("QUUV", "âu", "ʔəw"), ("RY", "rœ̆", "rɨ"), ("RYY", "rœ", "rɨː"), ("LY", "lœ̆", "lɨ"),
    ("LYY", "lœ", "lɨː"), ("QE", "ê", "ʔae~ʔɛː~ʔeː"), ("QAI", "ai", "ʔaj"), ("QOO TYPE ONE", "aô", "ʔao"), ("QOO TYPE TWO", "aô", "ʔao"), ("QAU", "au", "ʔaw"),
]
# Fixed values. Dependent vowels U+17B6-17C5: name, place, a-series IPA and romanization, o-series IPA and romanization.
DEPENDENT_VOWELS = [
    ("AA", "right", "aː", "a", "iːə", "éa"), ("I", "above", "ə", "ĕ", "ɨ~i", "ĭ"), ("II", "above", "ej", "ei", "iː", "i"), ("Y", "above", "ə", "œ̆", "ɨ", "ẏ"),
    ("YY", "above", "əː", "œ", "ɨː", "ȳ"), ("U", "below", "o", "ŏ", "u", "ŭ"), ("UU", "below", "oː", "o", "uː", "u"), ("UA", "below-right", "uə", "uŏ", None, None),
    ("OE", "right", "aə", "aeu", "əː", "eu"), ("YA", "right", "ɨə", "œă", None, None), ("IE", "right", "iə", "iĕ", None, None), ("E", "left", "eː", "é", None, None),
    ("AE", "left", "ae", "ê", "ɛː", "ae"), ("AI", "left", "ej", "ai", "aj", "ey"), ("OO", "left-right", "ao", "aô", "oː", "oŭ"), ("AU", "right", "aɨ", "au", "əɨ", "ŏu"),
]
# Fixed values. Signs U+17C6-17DD: name and kind.
SIGNS = [
    ("NIKAHIT", "SIGN"), ("REAHMUK", "SIGN"), ("YUUKALEAPINTU", "SIGN"), ("MUUSIKATOAN", "REGISTER_SHIFTER"), ("TRIISAP", "REGISTER_SHIFTER"), ("BANTOC", "SIGN"),
    ("ROBAT", "SIGN"), ("TOANDAKHIAT", "SIGN"), ("KAKABAT", "SIGN"), ("AHSDA", "SIGN"), ("SAMYOK SANNYA", "SIGN"), ("VIRIAM", "SIGN"), ("COENG", "COENG"),
    ("BATHAMASAT", "SIGN"), ("KHAN", "PUNCTUATION"), ("BARIYOOSAN", "PUNCTUATION"), ("CAMNUC PII KUUH", "PUNCTUATION"), ("LEK TOO", "PUNCTUATION"),
    ("BEYYAL", "PUNCTUATION"), ("PHNAEK MUAN", "PUNCTUATION"), ("KOOMUUT", "PUNCTUATION"), ("RIEL SIGN", "CURRENCY"), ("AVAKRAHASANYA", "OTHER"), ("ATTHACAN", "SIGN"),
]
DIGITS = ["ZERO", "ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE"]
LEK_ATTAK = ["SON", "MUOY", "PII", "BEI", "BUON", "PRAM", "PRAM-MUOY", "PRAM-PII", "PRAM-BEI", "PRAM-BUON"]

COENG, ZWSP, ZWNJ, ZWJ = "្", "​", "‌", "‍"
MUUSIKATOAN, TRIISAP, NIKAHIT, REAHMUK, TOANDAKHIAT = "៉", "៊", "ំ", "ះ", "៍"
INHERENT = {"a": "â", "o": "ô"}

#: Types that join the cluster before them.
ATTACHING = frozenset({"DEPENDENT_VOWEL", "INHERENT_VOWEL", "REGISTER_SHIFTER", "DIACRITIC", "COENG", "SUBSCRIPT_CONSONANT"})
#: Types that count as Khmer script.
KHMER_TYPES = frozenset({"CONSONANT", "SUBSCRIPT_CONSONANT", "INDEPENDENT_VOWEL", "DEPENDENT_VOWEL", "INHERENT_VOWEL", "REGISTER_SHIFTER", "COENG", "DIACRITIC", "DIGIT", "LEK_ATTAK", "PUNCTUATION", "CURRENCY", "OTHER_KHMER"})
_SIGN_TYPES = {"SIGN": "DIACRITIC", "OTHER": "OTHER_KHMER"}


@lru_cache(None)
def type_table() -> dict[str, str]:
    """Type of each assigned or unassigned code point of the block, and of the three zero-width ones."""
    table = {chr(cp): "UNASSIGNED" for cp in range(0x1780, 0x1800)}
    for first, rows, kind in ((0x1780, CONSONANTS, "CONSONANT"), (0x17A3, INDEPENDENT_VOWELS, "INDEPENDENT_VOWEL"), (0x17B4, (1, 2), "INHERENT_VOWEL"), (0x17B6, DEPENDENT_VOWELS, "DEPENDENT_VOWEL"), (0x17E0, DIGITS, "DIGIT"), (0x17F0, LEK_ATTAK, "LEK_ATTAK")):
        table |= {chr(first + i): kind for i in range(len(rows))}
    table |= {chr(0x17C6 + i): _SIGN_TYPES.get(kind, kind) for i, (_, kind) in enumerate(SIGNS)}
    return table | {ZWSP: "ZERO_WIDTH", ZWNJ: "ZERO_WIDTH", ZWJ: "ZERO_WIDTH"}


def classify_codepoint(ch: str) -> str:
    """Type of a character by itself."""
    return type_table().get(ch) or ("WHITESPACE" if ch.isspace() else "NON_KHMER")


def classify(text: str) -> list[str]:
    """Types of all characters in their context: a consonant after COENG (across joiners) is a subscript."""
    out, after_coeng = [], False
    for ch in text:
        kind = classify_codepoint(ch)
        if kind == "CONSONANT" and after_coeng:
            kind = "SUBSCRIPT_CONSONANT"
        if ch not in (ZWNJ, ZWJ):
            after_coeng = ch == COENG
        out.append(kind)
    return out


def series_of(ch: str) -> str | None:
    """Series of a consonant; independent vowels are a-series."""
    kind = classify_codepoint(ch)
    if kind == "CONSONANT":
        return CONSONANTS[ord(ch) - 0x1780][1]
    return "a" if kind == "INDEPENDENT_VOWEL" else None


def romanized(ch: str) -> str | None:
    """Romanization of a consonant, independent vowel or digit by itself."""
    cp, kind = ord(ch), classify_codepoint(ch)
    if kind == "CONSONANT":
        return CONSONANTS[cp - 0x1780][2]
    if kind == "INDEPENDENT_VOWEL":
        return INDEPENDENT_VOWELS[cp - 0x17A3][1]
    return str(cp - 0x17E0) if kind == "DIGIT" else None


def unicode_name(ch: str) -> str:
    return unicodedata.name(ch, "UNKNOWN")


# --- regex classes ----------------------------------------------------------------------------------------------------


def _span(a: int, b: int) -> str:
    return f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}"


@lru_cache(None)
def combining_class() -> str:
    """Code points outside the block that attach to what precedes them (canonical combining class not 0)."""
    cps = [cp for cp in range(0x110000) if not 0x1780 <= cp < 0x1800 and unicodedata.combining(chr(cp))]
    spans, start = [], cps[0]
    for a, b in zip(cps, [*cps[1:], None], strict=True):
        if b != a + 1:
            spans.append(_span(start, a))
            start = b
    return "".join(spans)


ZW = "\\x{200C}\\x{200D}"
CONS = "\\x{1780}-\\x{17A2}"
MARK = "\\x{17B4}-\\x{17D1}\\x{17D3}\\x{17DD}"
WSN = "\\x{09}\\x{0B}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WS = WSN + "\\x{0A}"
BND = WS + "\\x{17D4}-\\x{17DA}\\x{200B}" + ZW
_STACK = f"\\x{{17D2}}[{ZW}]*[{CONS}]?"
ATT = f"(?:{_STACK}|[{MARK}{ZW}{combining_class()}])*"
#: One cluster: a base (or a stack that has none) and all that attaches to it.
KCC = f"(?s)(?:{_STACK}|.){ATT}"
#: The same for Java: without backtracking, and with a look at ranges that hold no combining character before the many
#: that do (a class is a chain of tests there).
_JAVA_ATT = f"(?:{_STACK}|[{MARK}{ZW}]|(?![\\x{{0}}-\\x{{2FF}}\\x{{1780}}-\\x{{17FF}}\\x{{4E00}}-\\x{{9FFF}}])[{combining_class()}])*+"
KCC_JAVA = f"(?s)(?:{_STACK}|.){_JAVA_ATT}"
#: Group 1: a word between hints (spaces, zero-width spaces, punctuation).
WORD = f"(?s)[{BND}]{ATT}|((?:(?:{_STACK}|[^{BND}\\x{{17D2}}]){ATT})+)"
WORD_JAVA = f"(?s)[{BND}]{_JAVA_ATT}|((?:(?:{_STACK}|[^{BND}\\x{{17D2}}]){_JAVA_ATT})++)"
_ENDS = "\\x{17D4}\\x{17D5}.!?"
SENTENCE = f"[^{_ENDS}]*[{_ENDS}]+|[^{_ENDS}]+"
KHMER_CHARS = "[\\x{1780}-\\x{17DD}\\x{17E0}-\\x{17E9}\\x{17F0}-\\x{17F9}]"
KHMER_LETTERS = "[\\x{1780}-\\x{17B3}\\x{17D7}\\x{17DC}]"
UNASSIGNED = "[\\x{17DE}\\x{17DF}\\x{17EA}-\\x{17EF}\\x{17FA}-\\x{17FF}]"
ORPHAN = "\\A[\\x{17B4}-\\x{17D3}\\x{17DD}]"
ANY_KHMER = "[\\x{1780}-\\x{17FF}]"


# --- the tables as DataFrames -----------------------------------------------------------------------------------------


def character_records() -> list[tuple]:
    """One record per character of the block: code point, hex, char, name, type, series, romanizations, IPA, place, value."""
    out = []

    def add(cp: int, name: str, **own) -> None:
        ch = chr(cp)
        base = {"series": None, "romanization": None, "romanization_o": None, "ipa": None, "ipa_o": None, "place": None, "value": None} | own
        out.append((cp, f"U+{cp:04X}", ch, name, classify_codepoint(ch), *base.values()))

    for i, (name, series, roman, ipa) in enumerate(CONSONANTS):
        add(0x1780 + i, name, series=series, romanization=roman, ipa=ipa)
    for i, (name, roman, ipa) in enumerate(INDEPENDENT_VOWELS):
        add(0x17A3 + i, name, series="a", romanization=roman, ipa=ipa)
    for i, name in enumerate(("INHERENT AQ", "INHERENT AA")):
        add(0x17B4 + i, name)
    for i, (name, place, ipa_a, roman_a, ipa_o, roman_o) in enumerate(DEPENDENT_VOWELS):
        add(0x17B6 + i, name, romanization=roman_a, romanization_o=roman_o, ipa=ipa_a, ipa_o=ipa_o, place=place)
    for i, (name, _) in enumerate(SIGNS):
        add(0x17C6 + i, name)
    for first, names in ((0x17E0, DIGITS), (0x17F0, [f"LEK ATTAK {n}" for n in LEK_ATTAK])):
        for i, name in enumerate(names):
            add(first + i, name, value=i, romanization=str(i) if first == 0x17E0 else None)
    return out


CHARACTER_SCHEMA = "codepoint int, codepoint_hex string, char string, name string, type string, series string, romanization string, romanization_o string, ipa string, ipa_o string, place string, value int"


def characters(spark: SparkSession) -> DataFrame:
    """The character database (fixed, 124 rows)."""
    return spark.createDataFrame(character_records(), CHARACTER_SCHEMA)
