"""Problem 2: one consistent form for texts that look the same though their characters differ.

A text is brought to its form in these steps, of which most texts need none (a vectorised look over the code points of
the whole batch finds those that do):

1. invisible characters go, kinds of space and line break become the plain ones;
2. full-width and half-width forms, ligatures, radicals and other presentation forms become the plain characters,
   hyphens become ``-``, accents are composed;
3. each token of Latin, Cyrillic, Greek, Armenian, Cherokee, Lisu or Coptic letters is resolved: every letter has the set of scripts in which
   it can be spelled (its own, and those with a letter of the same picture), the sets are intersected over the token,
   and the token is spelled in the first script left, Latin before the others. That finds mixed-script tokens and
   tokens wholly written in look-alikes. A token whose sets have nothing in common gets Latin letters where it can;
4. Khmer marks within a cluster are put in one order and sequences with the picture of another sequence become that;
   Thai and Lao vowels typed as two signs become one.

Case, accents, digits of other scripts, words, and the number of spaces and line breaks stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.llm._text import codepoints, map_text, strings
from borei.session import use_checkpoints

# Letters of other scripts with the picture of a Latin letter, after Unicode Technical Standard 39.
CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝӏү", "ABEKMHOPCTYXSIJQWaeopcyxsijhdqwly", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿορνϲϳ", "ABEZHIKMNOPTYXCJopvcj", strict=True))
ARMENIAN = dict(zip("ՕՍՏԼօսհոցզ", "OUSLouhngq", strict=True))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTAJEWMHYGZbRVSLCPKdB", strict=True))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU", strict=True))
COPTIC = dict(zip("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥⲭ", "ABHIKMNOPCTYXopcx", strict=True))
LATIN = {"Ð": "Đ", "Ɖ": "Đ", "ɑ": "a", "ɡ": "g"}
HYPHENS = "‐‑‒–−⁃˗"
#: Compatibility forms whose picture is that of the plain characters.
SAME_PICTURE = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}
# Formatting characters that are seen, and invisible ones that aren't of the category Cf.
SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2}
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10)}

_SCRIPTS = (("Latin", {}), ("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN), ("Cherokee", CHEROKEE), ("Lisu", LISU), ("Coptic", COPTIC))
_TO_LATIN = {letter: latin for _, table in _SCRIPTS for letter, latin in table.items()}
# Where the letters of these scripts lie.
_PLACES = {"Greek": ((0x370, 0x3E2), (0x3F0, 0x400), (0x1F00, 0x2000)), "Cyrillic": ((0x400, 0x530),), "Armenian": ((0x530, 0x590),), "Cherokee": ((0x13A0, 0x1400), (0xAB70, 0xABC0)), "Lisu": ((0xA4D0, 0xA500),), "Coptic": ((0x3E2, 0x3F0), (0x2C80, 0x2D00))}
_FROM_LATIN = {name: {latin: own for own, latin in reversed(table.items())} for name, table in _SCRIPTS[1:]}
_FOREIGN = "".join(f"{chr(a)}-{chr(b - 1)}" for spans in _PLACES.values() for a, b in spans)
_ALPHABETIC = "A-Za-zªºÀ-ɏɐ-ʯʰ-˿̀-ͯḀ-ỿ" + _FOREIGN
_TOKEN = re.compile(f"[{_ALPHABETIC}]+")
_OTHER_SCRIPT = re.compile(f"[{_FOREIGN}]")


@lru_cache(None)
def _plain() -> dict[int, str]:
    """Rule-built: what single characters become in steps 1 and 2."""
    table: dict[int, str] = {}
    for cp in [*range(0x20000), *range(0xE0000, 0xE1000)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if (kind == "Cf" and cp not in SEEN_FORMAT) or cp in UNSEEN or (kind == "Cc" and ch not in "\t\n\r\x85\x0b\x0c") or cp >= 0xE0000:
            table[cp] = ""
        elif kind == "Zs":
            table[cp] = " "
        elif ch in "\x85\u2028\u2029":
            table[cp] = "\n"
        elif ch in HYPHENS:
            table[cp] = "-"
        elif ch in LATIN:
            table[cp] = LATIN[ch]
        else:
            parts = unicodedata.decomposition(ch).split()
            if parts and parts[0] in SAME_PICTURE and parts[1] != "0020" and ch != "ſ":
                table[cp] = unicodedata.normalize("NFKC", ch)
    for cp in (0x20, 0xE33, 0xEB3):  # the space, and vowels that _southeast composes
        del table[cp]
    table |= {0x17A3: "អ", 0x17A4: "អា", 0x17D8: "។ល។"}
    return table


# --- Khmer clusters, Thai and Lao -------------------------------------------------------------------------------------

_MARKS = re.compile("(?:\u17d2[\u1780-\u17b3]|[\u17b6-\u17d1\u17d3\u17dd])+")
_MARK = re.compile("\u17d2[\u1780-\u17b3]|[\u17b6-\u17d1\u17d3\u17dd]")
_ABOVE = frozenset("\u17b7\u17b8\u17b9\u17ba\u17be")
_SOUTHEAST = re.compile("([\u0e48-\u0e4b])([\u0e31\u0e34-\u0e37\u0e4d])|([\u0ec8-\u0ecb])([\u0eb1\u0eb4-\u0eb7\u0ebb\u0ecd])")


def _rank(mark: str) -> tuple[int, str]:
    if mark[0] == "\u17d2":
        return (1, mark) if mark[1] == "\u179a" else (0, "")
    if mark in "\u17c9\u17ca":
        return 2, mark
    return (3, mark) if mark <= "\u17c5" else (4, mark)


@lru_cache(20_000)
def _cluster(run: str) -> str:
    """The marks of one cluster in their order of one picture. Subscripts that aren't RO keep theirs."""
    marks = [m.replace("\u17d2\u178a", "\u17d2\u178f") for m in _MARK.findall(run)]
    if _ABOVE.intersection(marks) or {"\u17c1", "\u17b8"} <= set(marks):
        marks = ["\u17bb" if m in "\u17c9\u17ca" else m for m in marks]  # a shifter under a vowel above has the picture of this vowel
    out = "".join(sorted(marks, key=_rank))
    return out.replace("\u17b8\u17c1", "\u17be").replace("\u17b6\u17c1", "\u17c4").replace("\u17bb\u17be", "\u17be\u17bb")


def _southeast(text: str) -> str:
    text = _SOUTHEAST.sub(lambda m: (m[2] or m[4]) + (m[1] or m[3]), text)
    text = re.sub("\u0e4d([\u0e48-\u0e4b]?)\u0e32", "\\1\u0e33", text)
    text = re.sub("\u0ecd([\u0ec8-\u0ecb]?)\u0eb2", "\\1\u0eb3", text)
    return text.replace("\u0e40\u0e40", "\u0e41").replace("\u0ec0\u0ec0", "\u0ec1")


# --- tokens of several scripts ----------------------------------------------------------------------------------------


def scripts_of(letter: str) -> frozenset[str]:
    """The scripts in which a letter can be spelled: its own, and those with a letter of the same picture."""
    for name, table in _SCRIPTS[1:]:
        if letter in table:
            latin = table[letter]
            return frozenset({name, "Latin", *(other for other, back in _FROM_LATIN.items() if latin in back)})
    for name, spans in _PLACES.items():
        if any(a <= ord(letter) < b for a, b in spans):
            return frozenset({name})
    return frozenset({"Latin", *(other for other, back in _FROM_LATIN.items() if letter in back)})


@lru_cache(20_000)
def resolve_token(token: str) -> tuple[str, str]:
    """The consistent spelling of a token and what it was: single, mixed (resolved), whole (wholly look-alikes of
    Latin letters) or tangled (no script can spell all of it)."""
    letters = [c for c in unicodedata.normalize("NFD", token)]
    known = [scripts_of(c) for c in letters if not unicodedata.combining(c)]
    if not known:
        return token, "single"
    common = frozenset.intersection(*known)
    own = {next((name for name, table in _SCRIPTS[1:] if c in table), None) or (min(scripts_of(c)) if len(scripts_of(c)) == 1 else "Latin") for c in letters if not unicodedata.combining(c)}
    if not common:
        spelled, what = [_TO_LATIN.get(c, c) for c in letters], "tangled"
    elif "Latin" in common:
        spelled, what = [_TO_LATIN.get(c, c) for c in letters], "single" if own == {"Latin"} else "mixed" if len(own) > 1 else "whole"
    else:
        script = next(name for name, _ in _SCRIPTS if name in common)
        spelled, what = [c if script in ("", *own) and c not in _FROM_LATIN[script] and c not in _TO_LATIN else _FROM_LATIN[script].get(_TO_LATIN.get(c, c), c) for c in letters], "single" if len(own) == 1 else "mixed"
    return unicodedata.normalize("NFC", "".join(spelled)), what


def consistent_form(text: str | None) -> str | None:
    """The consistent form of one text (null stays null)."""
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = unicodedata.normalize("NFC", text).translate(_plain())
    text = unicodedata.normalize("NFC", text)
    if _OTHER_SCRIPT.search(text):
        text = _TOKEN.sub(lambda m: resolve_token(m[0])[0] if _OTHER_SCRIPT.search(m[0]) else m[0], text)
    return _southeast(_MARKS.sub(lambda m: _cluster(m[0]), text))


# --- which texts of a batch need it -------------------------------------------------------------------------------------


@lru_cache(None)
def _flags() -> np.ndarray:
    """By code point: 1 needs the steps, 2.. classes for pairs (Khmer, Thai, Lao marks)."""
    table = np.zeros(0x110000, np.uint8)
    table[list(_plain())] = 1
    for lo, hi in ((0x300, 0x370), (0x1100, 0x1200), (0xE0000, 0xE1000), *(span for spans in _PLACES.values() for span in spans)):
        table[lo:hi] = 1
    table[0x0D] = 1
    for cp in range(0x80, 0x30000):  # what composing changes, apart from Khmer, Thai and Lao signs
        ch = chr(cp)
        if unicodedata.normalize("NFC", ch) != ch or (unicodedata.combining(ch) and not (0xE00 <= cp < 0xF00 or 0x1780 <= cp < 0x1800)):
            table[cp] = 1
    return table


@lru_cache(None)
def _marks() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    table[0x17D2] = 1
    table[[0x17C9, 0x17CA]] = 2
    table[0x17B6:0x17C6] = 3
    table[[ord(c) for c in _ABOVE]] = 9
    table[[*range(0x17C6, 0x17C9), *range(0x17CB, 0x17D2), 0x17D3, 0x17DD]] = 4
    table[[*range(0xE48, 0xE4C), *range(0xEC8, 0xECC)]] = 5
    table[[0xE31, *range(0xE34, 0xE38), 0xEB1, *range(0xEB4, 0xEB8), 0xEBB]] = 6
    table[[0xE4D, 0xECD]] = 7
    table[[0xE40, 0xEC0]] = 8
    table[[0xE32, 0xEB2]] = 10
    return table


@lru_cache(None)
def _pairs() -> np.ndarray:
    """Pairs of neighbouring mark classes that ask for the steps."""
    ask = np.zeros((11, 11), bool)
    for a, b in ((2, 1), (3, 1), (4, 1), (3, 2), (4, 2), (2, 2), (3, 3), (4, 3), (4, 4), (2, 9), (5, 6), (5, 7), (8, 8), (7, 10)):
        ask[a, b] = True
    for pair in np.argwhere(ask[:, :9]):  # vowels above are vowels
        pair = np.where(pair == 3, 9, pair)
        ask[pair[0], pair[1]] = True
    ask[3, 9] = ask[9, 3] = ask[9, 9] = True
    return ask


def mark_order_doubt(cps: np.ndarray) -> np.ndarray:
    """Positions where sequences of marks may have the picture of others."""
    kind = _marks()[cps]
    at = np.flatnonzero(_pairs()[kind[:-1], kind[1:]]) if len(cps) > 1 else np.zeros(0, np.int64)
    if len(cps) < 3:
        return at
    ro = np.flatnonzero((kind[:-2] == 1) & (cps[1:-1] == 0x179A) & (kind[2:] == 1))
    am = np.flatnonzero((kind[:-2] == 7) & (kind[1:-1] == 5) & (kind[2:] == 10))
    return np.concatenate([at, ro, am])


def coeng_da(cps: np.ndarray) -> np.ndarray:
    """Where a subscript DA stands, which has the picture of a subscript TA."""
    return np.flatnonzero((cps[:-1] == 0x17D2) & (cps[1:] == 0x178A)) + 1 if len(cps) > 1 else np.zeros(0, np.int64)


def needs_form(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text of a batch whether :func:`consistent_form` may change it."""
    at = np.concatenate([np.flatnonzero(_flags()[cps] == 1), mark_order_doubt(cps), coeng_da(cps)])
    need = np.zeros(len(starts) - 1, bool)
    need[np.searchsorted(starts, at, side="right") - 1] = True
    return need


def consistent_forms(texts: list[str | None]) -> list[str | None]:
    need = needs_form(*codepoints(texts)) if texts else np.zeros(0, bool)
    return [consistent_form(t) if n and t else t for t, n in zip(texts, need, strict=True)]


def _visible(text: str) -> bool:
    return not text.isspace() and text != ""


def with_consistent_form(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and ``form``, the consistent form of each row's text. Null gives null, empty gives empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(consistent_forms(strings(batch, "_text")), pa.string())], [key, "form"])

    kind = df.schema[key].dataType.simpleString()
    return map_text(df.select(key, F.col(text).alias("_text")), "_text", run, f"`{key}` {kind}, form string")


def form_keys(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``form_key`` and ``text_key``: 128-bit digests of the consistent form and of the text as stored. Rows
    whose text is null or shows nothing are left out."""

    def digest(value: str) -> bytes:
        return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch, "_text")
        keep, forms, raws = [], [], []
        for i, (text, form) in enumerate(zip(texts, consistent_forms(texts), strict=True)):
            if form is not None and _visible(form):
                keep.append(i)
                raws.append(raw := digest(text))
                forms.append(raw if form is text else digest(form))
        ids = batch.column(0).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([ids, pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], [key, "form_key", "text_key"])

    kind = df.schema[key].dataType.simpleString()
    return map_text(df.select(key, F.col(text).alias("_text")), "_text", run, f"`{key}` {kind}, form_key binary, text_key binary")


def look_alike_pairs(df: DataFrame, key: str, text: str = "text", part: int = 20_000) -> DataFrame:
    """All pairs a < b of records whose texts have the same consistent form but differ in some character.

    Groups of plain copies never meet in a join: forms with one spelling only are left out by a pre-aggregated count
    before it, however many rows they hold. A form of more than ``part`` records is joined in parts, each record of a part
    with all of the form, so that no task gets all its pairs. Null keys, null texts and texts that show nothing give no pair; a record
    delivered again counts once."""
    use_checkpoints(df.sparkSession)
    rows = form_keys(df.where(F.col(key).isNotNull()), key, text).distinct().checkpoint()  # digests only; read three times below
    several = rows.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    rows = rows.join(several.select("form_key", F.ceil(F.col("n") / part).cast("int").alias("parts")), "form_key")
    a, b = (rows.select("form_key", "parts", F.col("text_key").alias(f"text_{s}"), F.col(key).alias(s)) for s in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return a.join(b.drop("parts"), ["form_key", "part"]).where("text_a <> text_b and a < b").select("a", "b").distinct()
