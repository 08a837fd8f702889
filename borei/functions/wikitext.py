"""Wiki markup to plain prose, as the corpus builder wants it: expressions of the JVM, no Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from borei import chars as C
from borei.functions import unicode as U

# Redirect words, and prefixes of links whose text is no prose.
REDIRECT = "(?i)^\\s*#(REDIRECT|ប្តូរទីតាំង)"
NO_PROSE = ("file:", "image:", "category:", "media:", "ឯកសារ:", "រូបភាព:", "ចំណាត់ថ្នាក់ក្រុម:")
# The marks of the markup and what stands for them in prose. Patterns that Java and RE2 read alike.
COMMENT, NOTE = "(?s)<!--.*?-->", "(?is)<ref[^>]*?/>|<ref[^>]*>.*?</ref>"
NESTED = (("{{", "}}"), ("{|", "|}"))
LINK = "(?s)\\[\\[(.*?)\\]\\]"
PROSE = (
    (f"\\[(?:https?|ftp)://[^{C.WS}\\]]+[{C.WS}]*([^\\]]*)\\]", "$1"),
    (f"(?m)^={{2,6}}[{C.WS}]*(.*?)[{C.WS}]*={{2,6}}[{C.WS}]*$", "$1"),
    ("'{2,5}", ""),
    ("<[^>]+>", " "),
    ("__[A-Z_]+__", ""),
    (f"(?m)^[*#:;]+[{C.WS}]*", ""),
    ("\n{3,}", "\n\n"),
)
#: Noncharacters that stand for marks while a text is taken apart.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def _lines(pattern: str) -> str:
    """For Java: only the line feed ends a line."""
    return "(?d)" + pattern


def without_nested(c: Column, opening: str, closing: str) -> Column:
    """Without balanced spans; an unclosed one takes the rest, a stray closer goes alone."""
    quoted = "|".join("".join(f"\\{x}" for x in mark) for mark in (opening, closing))
    parts = F.split(F.regexp_replace(c, f"({quoted})", f"{OPEN}$1{OPEN}"), OPEN, -1)
    state = lambda depth, kept: F.struct(depth.cast("int").alias("depth"), kept.alias("kept"))

    def step(s: Column, part: Column) -> Column:
        seen = F.when(s["depth"] == 0, F.array_append(s["kept"], part)).otherwise(s["kept"])
        return F.when(part == opening, state(s["depth"] + 1, s["kept"])).when(part == closing, state(F.greatest(s["depth"] - 1, F.lit(0)), s["kept"])).otherwise(state(s["depth"], seen))

    plain = F.aggregate(parts, state(F.lit(0), F.array().cast("array<string>")), step, lambda s: F.array_join(s["kept"], ""))
    return F.when(c.rlike(quoted), plain).otherwise(c)


def _nested(opening: str, closing: str) -> Callable[[Column], Column]:
    return lambda c: without_nested(c, opening, closing)


def without_links(c: Column) -> Column:
    """Links become what they show (what stands behind their last bar); those to files and categories go; what isn't closed
    stays as it is."""
    c = F.regexp_replace(c, LINK, f"{OPEN}$1{CLOSE}")
    c = F.regexp_replace(c, f"(?iu){OPEN}(?:{'|'.join(NO_PROSE)})[^{CLOSE}]*{CLOSE}", "")
    return F.regexp_replace(c, f"{OPEN}(?:[^{CLOSE}]*\\|)?([^{CLOSE}|]*){CLOSE}", "$1")


def clean_wikitext(c: Column | str) -> Column:
    """Plain text of wiki markup; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    for pattern in (COMMENT, NOTE):
        c = F.regexp_replace(c, pattern, " ")
    for marks in NESTED:
        c = U.let(c, _nested(*marks))
    c = without_links(c)
    for pattern, to in PROSE:
        c = F.regexp_replace(c, _lines(pattern), to)
    return U.trim_ws(c)


def is_redirect(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(REDIRECT)
