"""Column builders of the Unicode engine. All are built-in expressions (no Python per row), apart from :func:`nfc`."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from borei import chars as C


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def every(c: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern as an array."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group))


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row. Spark shares no work inside lambdas, so an array that a lambda
    reads must be a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Stands between the items of joined runs, so that different runs never join to the same string.
SEPARATOR = "\ue001"


# --- clusters ---------------------------------------------------------------------------------------------------------


def graphemes(c: Column | str) -> Column:
    """Khmer character clusters, as an array of strings; null for null."""
    return every(c, C.KCC_JAVA)


#: Syllables are clusters in this model.
syllables = graphemes


@lru_cache(None)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\U%08x" % int(m[1], 16), pattern))


def python_pieces(text: str, pattern: str) -> list[tuple[str, int, int]]:
    """Matches of one of this module's patterns with their ranges, outside Spark."""
    return [(m[0], m.start(), m.end()) for m in _compiled(pattern).finditer(text)]


@pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _spans(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"text": x, "start": a, "end": b} for x, a, b in python_pieces(t, p)] for t, p in zip(texts, patterns, strict=True)])


def spans(c: Column | str, pattern: str) -> Column:
    """Matches with their half-open ranges (Arrow batches: running sums of lengths are quadratic as array functions)."""
    return _spans(_c(c), F.lit(pattern))


def grapheme_spans(c: Column | str) -> Column:
    """Clusters with their positions."""
    return spans(c, C.KCC)


def characters(c: Column | str) -> Column:
    return every(c, "(?s).")


def _types() -> Column:
    items = [x for ch, kind in sorted(C.type_table().items()) for x in (F.lit(ch), F.lit(kind))]
    return F.create_map(*items)


def char_type(ch: Column) -> Column:
    """Type of a single character by itself."""
    return F.coalesce(F.try_element_at(_types(), ch), F.when(ch.rlike(f"^[{C.WS}]$"), "WHITESPACE").otherwise("NON_KHMER"))


def char_types(c: Column | str) -> Column:
    """Types of all characters in context; a consonant after COENG (across joiners) is a subscript."""
    subscripts = F.regexp_replace(_c(c), f"(\\x{{17D2}}[{C.ZW}]*)[{C.CONS}]", "$1\ue000")
    return F.transform(characters(subscripts), lambda ch: F.when(ch == "\ue000", "SUBSCRIPT_CONSONANT").otherwise(char_type(ch)))


def clusters(c: Column | str) -> Column:
    """Each cluster taken apart: base, subscripts, register shifter, vowel and diacritics (the last shifter and vowel
    win; COENG and joiners are structure only)."""

    def apart(g: Column) -> Column:
        base, rest = F.substring(g, 1, 1), F.substring(g, 2, 1_000_000)
        loose = F.regexp_replace(rest, f"^([{C.ZW}]*)[{C.CONS}]", "$1")  # after a COENG that stands first
        own_sub = F.when(base == C.COENG, F.filter(F.array(F.regexp_extract(rest, f"^[{C.ZW}]*([{C.CONS}])", 1)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
        return F.struct(
            g.alias("text"),
            base.alias("base"),
            char_type(base).alias("base_type"),
            F.concat(own_sub, every(rest, f"\\x{{17D2}}[{C.ZW}]*([{C.CONS}])", 1)).alias("subscripts"),
            F.try_element_at(every(loose, "[\\x{17C9}\\x{17CA}]"), F.lit(-1)).alias("register_shifter"),
            F.try_element_at(every(loose, "[\\x{17B4}-\\x{17C5}]"), F.lit(-1)).alias("vowel"),
            every(loose, "[\\x{17C6}-\\x{17C8}\\x{17CB}-\\x{17D1}\\x{17D3}\\x{17DD}]").alias("diacritics"),
        )

    return F.transform(graphemes(c), apart)


# --- normalization ----------------------------------------------------------------------------------------------------


@pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    """Canonical composition (Arrow batches; Spark has no built-in)."""
    return _nfc(_c(c))


def collapse_zwsp(c: Column | str) -> Column:
    """Runs of zero-width spaces become one; those beside a space, tab or line break go."""
    c = F.regexp_replace(_c(c), "\\x{200B}{2,}", C.ZWSP)
    c = F.regexp_replace(c, "\\x{200B}([ \\t\\n])", "$1")
    return F.regexp_replace(c, "([ \\t\\n])\\x{200B}", "$1")


def trim_ws(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(c), f"\\A[{C.WS}]+|[{C.WS}]+\\z", "")


def normalize(c: Column | str, compose: bool = True) -> Column:
    """Composition, zero-width spaces, runs of blanks and of blank lines, trailing blanks of lines, both ends."""
    c = collapse_zwsp(nfc(c) if compose else c)
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    c = F.regexp_replace(c, f"[{C.WSN}]+(\\n|\\z)", "$1")
    return trim_ws(c)


def strip_zero_width(c: Column | str) -> Column:
    return F.translate(_c(c), C.ZWSP + C.ZWNJ + C.ZWJ, "")


def has_zero_width(c: Column | str) -> Column:
    return _c(c).rlike("[\\x{200B}-\\x{200D}]")


# --- sentences and words ----------------------------------------------------------------------------------------------


def sentences(c: Column | str) -> Column:
    """Sentences ended by runs of KHAN, BARIYOOSAN, point, exclamation or question mark, trimmed; blank ones dropped."""
    return F.filter(F.transform(every(c, C.SENTENCE), trim_ws), lambda s: s != "")


def sentence_spans(c: Column | str) -> Column:
    """Sentences with the ranges they were cut from; the text of each is trimmed."""
    cut = F.filter(spans(c, C.SENTENCE), lambda s: trim_ws(s["text"]) != "")
    return F.transform(cut, lambda s: F.struct(trim_ws(s["text"]).alias("text"), s["start"].alias("start"), s["end"].alias("end")))


def words(c: Column | str) -> Column:
    """Words between hints: spaces, zero-width spaces and punctuation."""
    return F.filter(every(c, C.WORD_JAVA, 1), lambda w: w != "")


# --- validation -------------------------------------------------------------------------------------------------------


def coeng_errors(c: Column | str) -> Column:
    return count(c, "\\x{17D2}") - count(c, f"\\x{{17D2}}[{C.ZW}]*[{C.CONS}]")


def error_count(c: Column | str) -> Column:
    """Structural errors: COENG without consonant, unassigned code points, a mark that nothing carries."""
    return coeng_errors(c) + count(c, C.UNASSIGNED) + _c(c).rlike(C.ORPHAN).cast("int")


def is_valid(c: Column | str) -> Column:
    return error_count(c) == 0


def issues(c: Column | str) -> Column:
    """All findings as (index, severity, code, char), ordered by index, then coeng, unassigned, cluster findings."""
    c = _c(c)

    def found(code: str, severity: str, rank: int, hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct(h["start"].alias("index"), F.lit(rank).alias("rank"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), h["char"].alias("char")))

    marked = F.regexp_replace(c, f"\\x{{17D2}}(?![{C.ZW}]*[{C.CONS}])", "\ue001")
    letters = F.transform(characters(marked), lambda ch, i: F.struct(i.alias("start"), ch.alias("char")))
    coeng = F.transform(F.filter(letters, lambda x: x["char"] == "\ue001"), lambda x: F.struct(x["start"].alias("start"), F.lit(C.COENG).alias("char")))
    unassigned = F.filter(letters, lambda x: x["char"].rlike(C.UNASSIGNED))
    gs = grapheme_spans(c)
    at = lambda test: F.transform(F.filter(gs, test), lambda g: F.struct(g["start"].alias("start"), F.substring(g["text"], 1, 1).alias("char")))
    orphan = at(lambda g: (g["start"] == 0) & g["text"].rlike(C.ORPHAN))
    vowels = at(lambda g: count(g["text"], "[\\x{17B6}-\\x{17C5}]") > 1)
    shifters = at(lambda g: count(g["text"], "[\\x{17C9}\\x{17CA}]") > 1)
    obsolete = F.filter(letters, lambda x: x["char"].rlike("[\\x{179D}\\x{179E}]"))
    legacy = F.filter(letters, lambda x: x["char"].rlike("[\\x{17A3}\\x{17A4}]"))
    every_one = F.concat(
        found("coeng-no-consonant", "error", 0, coeng),
        found("unassigned-codepoint", "error", 1, unassigned),
        found("orphan-combining-mark", "error", 2, orphan),
        found("multiple-vowel-signs", "warning", 3, vowels),
        found("multiple-register-shifters", "warning", 4, shifters),
        found("obsolete-consonant", "warning", 5, obsolete),
        found("legacy-independent-vowel", "warning", 6, legacy),
    )
    return F.transform(F.array_sort(every_one), lambda i: F.struct(i["index"].alias("index"), i["severity"].alias("severity"), i["code"].alias("code"), i["char"].alias("char")))


# --- transliteration --------------------------------------------------------------------------------------------------


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def transliterate(c: Column | str) -> Column:
    """A readable Latin form, cluster by cluster: consonants with subscripts, the vowel read in the base's series (as a
    register shifter turns it) or the inherent one, final signs; digits; all else as it stands."""
    cons = {chr(0x1780 + i): r for i, (_, _, r, _) in enumerate(C.CONSONANTS)}
    series = {chr(0x1780 + i): s for i, (_, s, _, _) in enumerate(C.CONSONANTS)}
    vowel_a = {chr(0x17B6 + i): v[3] for i, v in enumerate(C.DEPENDENT_VOWELS)}
    vowel_o = {chr(0x17B6 + i): v[5] or v[3] for i, v in enumerate(C.DEPENDENT_VOWELS)}
    single = {chr(0x17A3 + i): v[1] for i, v in enumerate(C.INDEPENDENT_VOWELS) if v[1]} | {chr(0x17E0 + i): str(i) for i in range(10)}
    m_cons, m_series, m_a, m_o, m_single = (_lookup(t) for t in (cons, series, vowel_a, vowel_o, single))

    def spoken(k: Column) -> Column:
        own = F.when(k["register_shifter"] == C.MUUSIKATOAN, "o").when(k["register_shifter"] == C.TRIISAP, "a").otherwise(F.try_element_at(m_series, k["base"]))
        vowel = F.coalesce(F.try_element_at(F.when(own == "o", m_o).otherwise(m_a), k["vowel"]), k["vowel"])
        silent = F.array_contains(k["diacritics"], C.TOANDAKHIAT)
        inherent = F.when(silent, "").when(own == "o", C.INHERENT["o"]).otherwise(C.INHERENT["a"])
        return F.concat(
            F.try_element_at(m_cons, k["base"]),
            F.array_join(F.transform(k["subscripts"], lambda s: F.coalesce(F.try_element_at(m_cons, s), s)), ""),
            F.coalesce(vowel, inherent),
            F.when(F.array_contains(k["diacritics"], C.NIKAHIT), "ṃ").otherwise(""),
            F.when(F.array_contains(k["diacritics"], C.REAHMUK), "ḥ").otherwise(""),
        )

    def one(k: Column) -> Column:
        return F.when(k["base_type"] == "CONSONANT", spoken(k)).when(k["base_type"].isin("INDEPENDENT_VOWEL", "DIGIT"), F.coalesce(F.try_element_at(m_single, k["base"]), k["base"])).otherwise(k["text"])

    return F.array_join(F.transform(clusters(c), one), "")


# --- script and quality -----------------------------------------------------------------------------------------------


def khmer_chars(c: Column | str) -> Column:
    return count(c, C.KHMER_CHARS)


def other_chars(c: Column | str) -> Column:
    return count(c, "\\p{L}") - count(c, C.KHMER_LETTERS)


def script_ratio(c: Column | str) -> Column:
    """Share of Khmer among characters that have a script; 0 where none has."""
    k, o = khmer_chars(c), other_chars(c)
    return F.coalesce(F.try_divide(k, k + o), F.when(_c(c).isNotNull(), F.lit(0.0)))


def language_score(c: Column | str) -> Column:
    return F.struct(script_ratio(c).alias("khmer_ratio"), khmer_chars(c).alias("khmer_chars"), other_chars(c).alias("other_chars"))


def is_khmer(c: Column | str, threshold: float = 0.5) -> Column:
    return script_ratio(c) >= threshold


def ngrams(items: Column, n: int, separator: str = "") -> Column:
    """All runs of n items as joined strings; none where there are fewer. Null for null."""

    def runs(g: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(g) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(g, i, F.lit(n)), separator))
        return F.when(F.size(g) >= n, some).when(g.isNotNull(), F.slice(g, 1, 0))

    return let(items, runs)


# The patterns of tags, entities and links.
MARKUP = ("</?[a-zA-Z][^>]{0,200}>", "&(?:[a-zA-Z]{2,10}|#\\d{1,5});", "https?://\\S+")


def _unicode_part(c: Column, g: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.try_divide(error_count(c), F.greatest(F.size(g), F.lit(1))))


def _repetition_part(g: Column, window: int) -> Column:
    return let(ngrams(g, window, SEPARATOR), lambda r: F.when(F.size(r) < 2, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_distinct(r)), F.size(r))))


def unicode_score(c: Column | str) -> Column:
    return _unicode_part(_c(c), graphemes(c))


def repetition_score(c: Column | str, window: int = 5) -> Column:
    """Distinct share of the runs of ``window`` clusters; 1 for texts of no more than one run."""
    return _repetition_part(graphemes(c), window)


def markup_score(c: Column | str) -> Column:
    """1 less the share of characters in tags, entities and links (characters in two of them count twice)."""
    c = _c(c)
    marked = sum((F.char_length(F.array_join(every(c, p), "")) for p in MARKUP), F.lit(0))
    return F.when(F.char_length(c) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(marked, F.char_length(c))))


WEIGHTS = {"script": 1.0, "unicode": 1.0, "repetition": 1.0, "markup": 0.5}
UNAVAILABLE = ("grammar", "readability")


def quality(c: Column | str, weights: dict[str, float] | None = None, source: Column | None = None) -> Column:
    """score, components and what can't be measured: the weighted geometric mean of the components (and of a score of
    the source, weight 1, if given); 0 if one that counts is not positive."""
    weights = dict(weights or WEIGHTS)
    shared = let(graphemes(c), lambda g: F.struct(_unicode_part(_c(c), g).alias("unicode"), _repetition_part(g, 5).alias("repetition")))
    given = {"script": script_ratio(c), "markup": markup_score(c)} | ({"source": source} if source is not None else {})
    measured = F.struct(shared.alias("g"), *[v.cast("double").alias(k) for k, v in given.items()])
    return let(measured, lambda m: _weighted(c, weights, m, list(given)))


def _weighted(c: Column | str, weights: dict[str, float], m: Column, given: list[str]) -> Column:
    parts = {"script": m["script"], "unicode": m["g"]["unicode"], "repetition": m["g"]["repetition"], "markup": m["markup"]}
    source = m["source"] if "source" in given else None
    if source is not None:
        parts["source"], weights["source"] = source, weights.get("source", 1.0)
    used = {k: w for k, w in weights.items() if w > 0 and k in parts}
    total = sum(used.values())
    if total:
        bad = F.least(*[parts[k] for k in used], F.lit(9.0)) <= 0
        mean = F.exp(sum((F.lit(w) * F.log(parts[k]) for k, w in used.items()), F.lit(0.0)) / total)
        score = F.when(_c(c).isNull(), None).when(bad, F.lit(0.0)).otherwise(mean)
    else:
        score = F.lit(0.0)
    return F.struct(score.alias("score"), F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v)]).alias("components"), F.array(*[F.lit(u) for u in UNAVAILABLE]).alias("unavailable"))


def quality_score(c: Column | str, weights: dict[str, float] | None = None) -> Column:
    return quality(c, weights)["score"]


def format_quality(report) -> str:
    """A quality struct that was collected, as text."""
    lines = [f"score {report['score']:.3f}", *(f"  {k:<12} {v:.3f}" for k, v in sorted(report["components"].items()))]
    return "\n".join([*lines, *(f"  {u:<12} not measured" for u in report["unavailable"])])


# --- hashes and sets --------------------------------------------------------------------------------------------------


def content_hash(c: Column | str, normalized: bool = False) -> Column:
    """SHA-256 of the text as it reads: normalized, without zero-width characters."""
    return F.sha2(strip_zero_width(_c(c) if normalized else normalize(c)), 256)


def shingles(c: Column | str, n: int = 5) -> Column:
    """Distinct runs of n clusters; a shorter text is one shingle, an empty one has none."""
    return let(graphemes(c), lambda g: F.when(F.size(g) == 0, F.slice(g, 1, 0)).when(F.size(g) < n, F.array(F.array_join(g, ""))).when(g.isNotNull(), F.array_distinct(ngrams(g, n))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), union))


def distinct_n(c: Column | str, n: int = 2) -> Column:
    """Distinct share of the n-grams of clusters; 0 where there is none."""
    return let(ngrams(graphemes(c), n, SEPARATOR), lambda g: F.coalesce(F.try_divide(F.size(F.array_distinct(g)), F.size(g)), F.lit(0.0)))


def longest_run(c: Column | str) -> Column:
    """Longest run of one cluster."""
    step = lambda a, g: F.struct(g.alias("last"), F.when(g == a["last"], a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(g == a["last"], a["run"] + 1).otherwise(1)).alias("best"))
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))
    return F.aggregate(graphemes(c), zero, step, lambda a: a["best"])
