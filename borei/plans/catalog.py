"""Queries over the test tables, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borei import chars as C
from borei.functions import unicode as U
from borei.functions.wikitext import COMMENT, LINK, NESTED, NO_PROSE, NOTE, PROSE, REDIRECT, clean_wikitext
from borei.operators import dedup, embeddings, evaluate, grammar, lexicon, lm, split, tokenizers
from borei.plans import analyzer, pipeline
from borei.session import read_table, scratch, spread
from borei.sources import io
from borei.sources.io import keep_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents delivered once: of rows with the same id, the one loaded last (they hold the same content)."""
    own = columns or ("id", "text", "source", "license", "domain", "language", "quality")
    rows = read_table(spark, folder, "corpus_document", *own)
    parts = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())  # as many as the scan has
    return rows.repartition(parts, "id").distinct()


DOCS = "(select distinct id, text, source, license, domain, language from corpus_document)"
N_GRAPHEMES = f"len(regexp_extract_all(text, {q(C.KCC)}))"
KHMER = f"len(regexp_extract_all(text, {q(C.KHMER_CHARS)}))"
OTHER = f"(len(regexp_extract_all(text, '\\p{{L}}')) - len(regexp_extract_all(text, {q(C.KHMER_LETTERS)})))"
RATIO = f"(case when {KHMER} + {OTHER} = 0 then 0.0 else {KHMER} / ({KHMER} + {OTHER})::double end)"
TRIM = f"regexp_replace(s, {q(f'\\A[{C.WS}]+|[{C.WS}]+\\z')}, '', 'g')"
ERRORS = f"(len(regexp_extract_all(text, '\\x{{17D2}}')) - len(regexp_extract_all(text, {q(f'\\x{{17D2}}[{C.ZW}]*[{C.CONS}]')})) + len(regexp_extract_all(text, {q(C.UNASSIGNED)})) + (case when regexp_matches(text, {q(C.ORPHAN)}) then 1 else 0 end))"


def normal_sql(column: str) -> str:
    """Normal form of a column in SQL."""
    x = f"nfc_normalize({column})"
    for pattern, to in (("\\x{200B}{2,}", C.ZWSP), ("\\x{200B}([ \\t\\n])", "\\1"), ("([ \\t\\n])\\x{200B}", "\\1"), ("[ \\t]+", " "), ("\\n{3,}", "\n\n"), (f"[{C.WSN}]+(\\n|\\z)", "\\1"), (f"\\A[{C.WS}]+|[{C.WS}]+\\z", "")):
        x = f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"
    return x


ZERO_WIDTH = f"translate({{}}, '{C.ZWSP}{C.ZWNJ}{C.ZWJ}', '')"
HASH = f"sha256({ZERO_WIDTH.format(normal_sql('text'))})"


def values(*rows: tuple) -> str:
    """Rows as an SQL list of values."""
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else q(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def sql_map(pairs: dict[str, str]) -> str:
    return "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in pairs.items()) + "}"


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline's counts on one folder."""
    return pipeline_stats(spark, folder)


# --- Unicode engine ---------------------------------------------------------------------------------------------------


@query(f"select language, count(*) as documents, sum({N_GRAPHEMES})::bigint as graphemes, round(avg({N_GRAPHEMES}), 6) as mean_graphemes, round(avg({RATIO}), 6) as mean_ratio from {DOCS} where text is not null group by language")
def grapheme_profile(spark, folder):
    rows = docs(spark, folder, "id", "text", "language").where("text is not null")
    n = F.size(U.graphemes("text"))
    return rows.select("language", n.alias("n"), U.script_ratio("text").alias("r")).groupBy("language").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("graphemes"), F.round(F.avg("n"), 6).alias("mean_graphemes"), F.round(F.avg("r"), 6).alias("mean_ratio"))


@query(f"select g as grapheme, count(*) as n from (select unnest(regexp_extract_all(text, {q(C.KCC)})) as g from {DOCS}) group by g order by n desc, g limit 50")
def grapheme_top(spark, folder):
    return docs(spark, folder, "id", "text").select(F.explode(U.graphemes("text")).alias("grapheme")).groupBy("grapheme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "grapheme").limit(50)


@query(f"select id, round({RATIO}, 6) as ratio, {KHMER} as khmer, {OTHER} as other from {DOCS} where text is not null")
def script_ratio(spark, folder):
    rows = docs(spark, folder, "id", "text").where("text is not null")
    return rows.select("id", F.round(U.script_ratio("text"), 6).alias("ratio"), U.khmer_chars("text").alias("khmer"), U.other_chars("text").alias("other"))


@query(f"select id from {DOCS} where {RATIO} >= 0.5")
def language_filter(spark, folder):
    return docs(spark, folder, "id", "text").where(U.is_khmer("text")).select("id")


@query(f"select id, {normal_sql('text')} as text from {DOCS} where text is not null")
def normalize_text(spark, folder):
    return (docs(spark, folder, "id", "text").where("text is not null")).select("id", U.normalize("text").alias("text"))


@query(f"select id, {ZERO_WIDTH.format('text')} as text, regexp_matches(text, '[\\x{{200B}}-\\x{{200D}}]') as had from {DOCS} where text is not null")
def strip_zero_width(spark, folder):
    rows = docs(spark, folder, "id", "text").where("text is not null")
    return rows.select("id", U.strip_zero_width("text").alias("text"), U.has_zero_width("text").alias("had"))


@query(f"select id, row_number() over (partition by id order by i) - 1 as pos, s as sentence from (select id, i, {TRIM} as s from (select id, unnest(p) as s, generate_subscripts(p, 1) as i from (select id, regexp_extract_all(text, {q(C.SENTENCE)}) as p from {DOCS}))) where s <> ''")
def sentences(spark, folder):
    return pipeline.to_sentences(docs(spark, folder, "id", "text"), "text", "id").select("id", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query(f"select id, w as word, count(*) as n from (select id, unnest(regexp_extract_all(text, {q(C.WORD)}, 1)) as w from {DOCS}) where w <> '' group by id, w")
def words(spark, folder):
    return docs(spark, folder, "id", "text").select("id", F.explode(U.words("text")).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(f"select id, {ERRORS} as errors, {ERRORS} = 0 as valid from {DOCS} where text is not null")
def unicode_errors(spark, folder):
    rows = docs(spark, folder, "id", "text").where("text is not null")
    return rows.select("id", U.error_count("text").alias("errors"), U.is_valid("text").alias("valid"))


@query(f"select round(avg(case when {ERRORS} = 0 then 1.0 else 0.0 end), 6) as validity_rate from {DOCS} where text is not null")
def validity_rate(spark, folder):
    return evaluate.validity_rate(docs(spark, folder, "id", "text").where("text is not null")).select(F.round("validity_rate", 6).alias("validity_rate"))


_ISSUES = [
    ("coeng-no-consonant", "error", f"len(regexp_extract_all(text, '\\x{{17D2}}')) - len(regexp_extract_all(text, {q(f'\\x{{17D2}}[{C.ZW}]*[{C.CONS}]')}))"),
    ("unassigned-codepoint", "error", f"len(regexp_extract_all(text, {q(C.UNASSIGNED)}))"),
    ("orphan-combining-mark", "error", f"case when regexp_matches(text, {q(C.ORPHAN)}) then 1 else 0 end"),
    ("multiple-vowel-signs", "warning", f"len(list_filter(regexp_extract_all(text, {q(C.KCC)}), lambda g: len(regexp_extract_all(g, '[\\x{{17B6}}-\\x{{17C5}}]')) > 1))"),
    ("multiple-register-shifters", "warning", f"len(list_filter(regexp_extract_all(text, {q(C.KCC)}), lambda g: len(regexp_extract_all(g, '[\\x{{17C9}}\\x{{17CA}}]')) > 1))"),
    ("obsolete-consonant", "warning", "len(regexp_extract_all(text, '[\\x{179D}\\x{179E}]'))"),
    ("legacy-independent-vowel", "warning", "len(regexp_extract_all(text, '[\\x{17A3}\\x{17A4}]'))"),
]


@query("select code, severity, n from (" + " union all ".join(f"select '{code}' as code, '{severity}' as severity, sum({n})::bigint as n from {DOCS} where text is not null" for code, severity, n in _ISSUES) + ") where n > 0")
def validation_issues(spark, folder):
    found = docs(spark, folder, "id", "text").select(F.explode(U.issues("text")).alias("i"))
    return found.groupBy("i.code", "i.severity").agg(F.count(F.lit(1)).alias("n"))


def _spoken_sql(g: str) -> str:
    """A cluster as it is read, in SQL."""
    first, rest = f"substr({g}, 1, 1)", f"substr({g}, 2)"
    cons = {chr(0x1780 + i): r for i, (_, _, r, _) in enumerate(C.CONSONANTS)}
    o_series = "".join(chr(0x1780 + i) for i, (_, s, _, _) in enumerate(C.CONSONANTS) if s == "o")
    a, o = ({chr(0x17B6 + i): v[k] or v[3] for i, v in enumerate(C.DEPENDENT_VOWELS)} for k in (3, 5))
    single = {chr(0x17A3 + i): v[1] for i, v in enumerate(C.INDEPENDENT_VOWELS) if v[1]} | {chr(0x17E0 + i): str(i) for i in range(10)}
    shifter = f"list_last(regexp_extract_all({rest}, '[{C.MUUSIKATOAN}{C.TRIISAP}]'))"
    series = f"(case {shifter} when '{C.MUUSIKATOAN}' then 'o' when '{C.TRIISAP}' then 'a' else (case when contains('{o_series}', {first}) then 'o' else 'a' end) end)"
    vowel = f"list_last(regexp_extract_all({rest}, '[\\x{{17B4}}-\\x{{17C5}}]'))"
    read = f"(case when {vowel} is null then (case when contains({rest}, '{C.TOANDAKHIAT}') then '' when {series} = 'o' then '{C.INHERENT['o']}' else '{C.INHERENT['a']}' end) else coalesce(case when {series} = 'o' then {sql_map(o)}[{vowel}] else {sql_map(a)}[{vowel}] end, {vowel}) end)"
    below = f"array_to_string(list_transform(regexp_extract_all({rest}, {q(f'\\x{{17D2}}[{C.ZW}]*([{C.CONS}])')}, 1), lambda s: coalesce({sql_map(cons)}[s], s)), '')"
    signs = f"(case when contains({rest}, '{C.NIKAHIT}') then 'ṃ' else '' end) || (case when contains({rest}, '{C.REAHMUK}') then 'ḥ' else '' end)"
    return f"(case when regexp_matches({first}, '[{C.CONS}]') then {sql_map(cons)}[{first}] || {below} || {read} || {signs} when regexp_matches({first}, '[\\x{{17A3}}-\\x{{17B3}}\\x{{17E0}}-\\x{{17E9}}]') then coalesce({sql_map(single)}[{first}], {first}) else {g} end)"


LATIN = f"array_to_string(list_transform(regexp_extract_all(text, {q(C.KCC)}), lambda g: {_spoken_sql('g')}), '')"


@query(f"select id, {LATIN} as latin from {DOCS}")
def transliterate(spark, folder):
    return docs(spark, folder, "id", "text").select("id", U.transliterate("text").alias("latin"))


_KINDS = {}
for _ch, _kind in C.type_table().items():
    _KINDS.setdefault(_kind, []).append(f"\\x{{{ord(_ch):X}}}")
KIND = "(case " + " ".join(f"when regexp_matches(g, '^[{''.join(cps)}]') then '{kind}'" for kind, cps in _KINDS.items()) + f" when regexp_matches(g, '^[{C.WS}]') then 'WHITESPACE' else 'NON_KHMER' end)"
_BELOW = f"len(regexp_extract_all(substr(g, 2), {q(f'\\x{{17D2}}[{C.ZW}]*[{C.CONS}]')})) + (case when regexp_matches(g, {q(f'^\\x{{17D2}}[{C.ZW}]*[{C.CONS}]')}) then 1 else 0 end)"


@query(f"select {KIND} as base_type, ({_BELOW})::int as subscripts, regexp_matches(substr(g, 2), '[\\x{{17B4}}-\\x{{17C5}}]') as has_vowel, count(*) as n from (select unnest(regexp_extract_all(text, {q(C.KCC)})) as g from {DOCS}) group by all")
def clusters(spark, folder):
    parts = docs(spark, folder, "id", "text").select(F.explode(U.clusters("text")).alias("k"))
    return parts.groupBy("k.base_type", F.size("k.subscripts").alias("subscripts"), F.col("k.vowel").isNotNull().alias("has_vowel")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select t as type, count(*) as n from (select case when c between chr(6016) and chr(6050) then 'CONSONANT' when c between chr(6112) and chr(6121) then 'DIGIT' when regexp_matches(c, '[{C.WS}]') then 'WHITESPACE' else 'REST' end as t from (select unnest(regexp_extract_all(text, '(?s).')) as c from {DOCS})) group by t")
def character_types(spark, folder):
    kind = F.col("type")
    parts = docs(spark, folder, "id", "text").select(F.explode(U.char_types("text")).alias("type"))
    named = F.when(kind.isin("CONSONANT", "SUBSCRIPT_CONSONANT"), "CONSONANT").when(kind.isin("DIGIT", "WHITESPACE"), kind).otherwise("REST")
    return parts.groupBy(named.alias("type")).agg(F.count(F.lit(1)).alias("n"))


_NORMAL = f"(select id, {normal_sql('text')} as text from {DOCS})"


@query(f"select id, {LATIN} as transliteration, {ERRORS} = 0 as is_valid, {N_GRAPHEMES}::int as graphemes, len(list_filter(regexp_extract_all(text, {q(C.WORD)}, 1), lambda w: w <> ''))::int as words from {_NORMAL}")
def analyze_texts(spark, folder):
    return analyzer.analyze((docs(spark, folder, "id", "text")), "id").select("id", "transliteration", "is_valid", F.size("graphemes").alias("graphemes"), F.size("words").alias("words"))


# --- corpus -----------------------------------------------------------------------------------------------------------


_FIVE = f"(select id, g, len(g) as n from (select id, regexp_extract_all(text, {q(C.KCC)}) as g from {DOCS} where text is not null))"
_RUNS = f"(select id, generate_subscripts(g, 1) as i, unnest(g) as c from (select id, regexp_extract_all(text, {q(C.KCC)}) as g from {DOCS} where text is not null))"


@query(f"select id, round(case when n < 6 then 1.0 else len(list_distinct([g[i:i+4] for i in generate_series(1, n - 4)])) / (n - 4)::double end, 6) as repetition from {_FIVE}")
def repetition(spark, folder):
    rows = docs(spark, folder, "id", "text").where("text is not null")
    return rows.select("id", F.round(U.repetition_score("text"), 6).alias("repetition"))


_MARKED = " + ".join(f"length(array_to_string(regexp_extract_all(text, {q(p)}), ''))" for p in U.MARKUP)


@query(f"select id, round(case when length(text) = 0 then 1.0 else greatest(0.0, 1 - ({_MARKED}) / length(text)::double) end, 6) as markup from {DOCS} where text is not null")
def markup(spark, folder):
    rows = docs(spark, folder, "id", "text").where("text is not null")
    return rows.select("id", F.round(U.markup_score("text"), 6).alias("markup"))


_PARTS = f"(select id, {RATIO} as script, greatest(0.0, 1 - {ERRORS} / greatest({N_GRAPHEMES}, 1)::double) as unicode, case when n < 6 then 1.0 else len(list_distinct([array_to_string(g[i:i+4], chr(57345)) for i in generate_series(1, n - 4)])) / (n - 4)::double end as repetition, case when length(text) = 0 then 1.0 else greatest(0.0, 1 - ({_MARKED}) / length(text)::double) end as markup from (select id, text, g, len(g) as n from (select id, text, regexp_extract_all(text, {q(C.KCC)}) as g from {DOCS} where text is not null)))"
_SCORE = "(case when least(script, unicode, repetition, markup) <= 0 then 0.0 else exp((ln(script) + ln(unicode) + ln(repetition) + 0.5 * ln(markup)) / 3.5) end)"


@query(f"select id, round({_SCORE}, 6) as score, round(script, 6) as script, round(unicode, 6) as unicode, round(repetition, 6) as repetition, round(markup, 6) as markup from {_PARTS}")
def quality(spark, folder):
    rows = docs(spark, folder, "id", "text").where("text is not null").select("id", U.quality("text").alias("q"))
    return rows.select("id", F.round("q.score", 6).alias("score"), *[F.round(F.col("q.components")[c], 6).alias(c) for c in ("script", "unicode", "repetition", "markup")])


@query(f"select id, {HASH} as hash from {DOCS} where text is not null")
def content_hash(spark, folder):
    return (docs(spark, folder, "id", "text").where("text is not null")).select("id", U.content_hash("text").alias("hash"))


@query(f"select hash, min(id) as head, count(*) as copies from (select id, {HASH} as hash from {DOCS} where text is not null) group by hash")
def exact_duplicates(spark, folder):
    rows = (docs(spark, folder, "id", "text").where("text is not null")).select("id", U.content_hash("text").alias("hash"))
    return dedup.exact_heads(rows, "id", "hash")


_FAMILY = values(*((i, str(a), str(b)) for i, (a, b) in enumerate(zip(*dedup.coefficients(), strict=True))))
_SHINGLED = f"(select id, case when n = 0 then [] when n < 5 then [array_to_string(g, '')] else list_distinct([array_to_string(g[i:i+4], '') for i in generate_series(1, n - 4)]) end as s from (select id, g, len(g) as n from (select id, regexp_extract_all(text, {q(C.KCC)}) as g from {DOCS} where text is not null)))"
_MODULUS = "18446744073709551616::hugeint"


@query(f"with f as (select i, a::hugeint as a, b::hugeint as b from (values {_FAMILY}) t(i, a, b)), x as (select id, ('0x' || substr(sha1(unnest(s)), 1, 8))::bigint::hugeint as x from {_SHINGLED}), m as (select id, i, min(((a * x + b) % {_MODULUS}) % {dedup.PRIME}::hugeint)::bigint as h from x, f group by id, i), full_ as (select id, list(h order by i) as signature from m group by id) select s.id, coalesce(signature, list_transform(range({dedup.HASHES}), lambda i: {dedup.NONE}::bigint)) as signature from {_SHINGLED} s left join full_ on s.id = full_.id")
def minhash_signatures(spark, folder):
    return dedup.signatures((docs(spark, folder, "id", "text").where("text is not null")), "id", U.shingles("text")).withColumnRenamed("sig", "signature")


def _near_sql(rows: str) -> str:
    """(id, duplicate) of ``rows`` (id, text) by keep-first, one document after the other."""
    h, agree = dedup.HASHES, f"len(list_filter(range(1, {dedup.HASHES + 1}), lambda i: a.sig[i] = b.sig[i])) / {dedup.HASHES}::double"
    cut = f"case when n = 0 then [] when n < 5 then [array_to_string(g, '')] else list_distinct([array_to_string(g[i:i+4], '') for i in generate_series(1, n - 4)]) end"
    return f"""(with recursive body as (select id, text, sha256({ZERO_WIDTH.format(normal_sql('text'))}) as h from (select id, coalesce(text, '') as text from {rows})),
        head as (select h, min(id) as head from body group by h), family as (select i, a::hugeint as a, b::hugeint as b from (values {_FAMILY}) t(i, a, b)),
        shingled as (select id, {cut} as s from (select id, g, len(g) as n from (select id, regexp_extract_all(text, {q(C.KCC)}) as g from body join head on id = head))),
        mins as (select id, i, min(((a * x + b) % {_MODULUS}) % {dedup.PRIME}::hugeint)::bigint as m from (select id, ('0x' || substr(sha1(unnest(s)), 1, 8))::bigint::hugeint as x from shingled), family group by id, i),
        signed as (select s.id, coalesce(f.sig, list_transform(range({h}), lambda i: {dedup.NONE}::bigint)) as sig from shingled s left join (select id, list(m order by i) as sig from mins group by id) f on s.id = f.id),
        band as (select id, sig, k, sig[k * {h // dedup.BANDS} + 1:(k + 1) * {h // dedup.BANDS}] as part from signed, range({dedup.BANDS}) t(k)),
        earlier as (select b.id, list(distinct a.id) as before from band a join band b on a.k = b.k and a.part = b.part and a.id < b.id where {agree} >= {dedup.THRESHOLD} group by b.id),
        placed as (select id, before, row_number() over (order by id) as r from earlier),
        walk(r, gone) as (select 0::bigint, []::varchar[] union all select p.r, case when len(list_filter(p.before, lambda x: not list_contains(w.gone, x))) > 0 then list_append(w.gone, p.id) else w.gone end from walk w join placed p on p.r = w.r + 1),
        dropped as (select unnest(gone) as id from walk where r = (select max(r) from walk))
        select body.id, case when head.head in (select id from dropped) then 'near' when head.head <> body.id then 'exact' end as duplicate from body join head on body.h = head.h)"""


@query(f"select * from {_near_sql(DOCS)}")
def near_duplicates(spark, folder):
    return dedup.deduplicate(docs(spark, folder, "id", "text"), "text", "id").select("id", "duplicate")


_STAGED = f"(select *, case when trim(coalesce(license, '')) = '' then 'missing_license' end as r1 from (select id, license, {normal_sql(chr(99) + chr(111) + 'alesce(text, ' + chr(39) * 2 + ')')} as text from {DOCS}))"
_HASHED = f"(select *, sha256({ZERO_WIDTH.format(normal_sql('text'))}) as h from {_STAGED})"
_RANKED = f"(select *, case when r1 is null and row_number() over (partition by r1, h order by id) > 1 then 'exact_duplicate' end as r2 from {_HASHED})"
_JUDGED = f"(select *, {RATIO} as ratio, {N_GRAPHEMES} as n, coalesce(r1, r2) as r from {_RANKED})"


@query(f"select coalesce(r, case when ratio < 0.5 then 'wrong_language' when n < 20 then 'too_short' else 'kept' end) as reason, count(*) as documents from {_JUDGED} group by 1")
def pipeline_reasons(spark, folder):
    """The pipeline with exact duplicates only and no quality bar, which SQL can follow."""
    result = pipeline.run_pipeline(docs(spark, folder, "id", "text", "license"), near_duplicate_threshold=1.0, min_quality=0.0)
    return result.verdicts.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


_PASSED = f"(select id, text from {_STAGED} where r1 is null)"
_SAID = f"(select s.id, case when s.r1 is not null then s.r1 when d.duplicate = 'exact' then 'exact_duplicate' when d.duplicate = 'near' then 'near_duplicate' when {RATIO} < 0.5 then 'wrong_language' when {N_GRAPHEMES} < 20 then 'too_short' end as r from {_STAGED} s left join {_near_sql(_PASSED)} d on s.id = d.id)"
_GRADED = f"(select a.id, coalesce(a.r, case when {_SCORE} < 0.6 then 'low_quality' end) as r from {_SAID} a join {_PARTS.replace(DOCS, _STAGED)} p on a.id = p.id)"


@query("select count(*) as input, " + ", ".join(f"count(*) filter (where r = '{r}') as {r}" for r in pipeline.REASONS) + f", count(*) filter (where r is null) as output from {_GRADED}")
def pipeline_stats(spark, folder):
    return pipeline.run_pipeline(docs(spark, folder, "id", "text", "source", "license", "domain", "language")).stats


@query("select split, documents from (select 'validation' as split, greatest(floor(n * 0.05), 1)::bigint as documents from (select count(distinct id) as n from corpus_document)) union all select 'test', greatest(floor(n * 0.05), 1)::bigint from (select count(distinct id) as n from corpus_document) union all select 'train', (n - 2 * greatest(floor(n * 0.05), 1))::bigint from (select count(distinct id) as n from corpus_document)")
def split_sizes(spark, folder):
    return split.split_sizes(split.split_documents(docs(spark, folder, "id")))


@query(f"select page_id, title from (select distinct page_id, title, ns, text from wiki_page) where ns = '0' and coalesce(title, '') <> '' and coalesce(text, '') <> '' and not regexp_matches(text, {q(REDIRECT)})")
def wiki_pages(spark, folder):
    return keep_pages(read_table(spark, folder, "wiki_page", "page_id", "title", "ns", "text").distinct()).select("page_id", "title")


def _wiki_sql(x: str) -> str:
    mark = "chr(64976)"
    for pattern in (COMMENT, NOTE):
        x = f"regexp_replace({x}, {q(pattern)}, ' ', 'g')"
    for a, b in NESTED:
        both = "|".join("".join(f"\\{c}" for c in m) for m in (a, b))
        parts = f"list_transform(string_split(regexp_replace({x}, {q(f'({both})')}, {mark} || '\\1' || {mark}, 'g'), {mark}), lambda p: {{'d': 0, 't': p}})"
        step = f"lambda s, p: case when p.t = {q(a)} then {{'d': s.d + 1, 't': s.t}} when p.t = {q(b)} then {{'d': greatest(s.d - 1, 0), 't': s.t}} when s.d = 0 then {{'d': s.d, 't': s.t || p.t}} else s end"
        x = f"list_reduce(list_prepend({{'d': 0, 't': ''}}, {parts}), {step}).t"
    x = f"regexp_replace({x}, {q(LINK)}, chr(64976) || '\\1' || chr(64977), 'g')"
    x = f"regexp_replace({x}, '(?i)\\x{{FDD0}}(?:{'|'.join(NO_PROSE)})[^\\x{{FDD1}}]*\\x{{FDD1}}', '', 'g')"
    x = f"regexp_replace({x}, '\\x{{FDD0}}(?:[^\\x{{FDD1}}]*\\|)?([^\\x{{FDD1}}|]*)\\x{{FDD1}}', '\\1', 'g')"
    for pattern, to in PROSE:
        x = f"regexp_replace({x}, {q(pattern)}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return f"regexp_replace({x}, {q(f'\\A[{C.WS}]+|[{C.WS}]+\\z')}, '', 'g')"


@query(f"select * from (select page_id, {_wiki_sql('text')} as text from (select distinct page_id, title, ns, text from wiki_page) where ns = '0' and coalesce(title, '') <> '' and coalesce(text, '') <> '' and not regexp_matches(text, {q(REDIRECT)})) where text <> ''")
def wiki_text(spark, folder):
    pages = spread(keep_pages(read_table(spark, folder, "wiki_page", "page_id", "title", "ns", "text").distinct()))
    return pages.select("page_id", clean_wikitext("text").alias("text")).where("text <> ''")


@query("select id, text, loaded_at from (select id, text, loaded_at, row_number() over (partition by id order by loaded_at desc, text desc nulls last) as r from corpus_document) where r = 1")
def latest_deliveries(spark, folder):
    """Of rows with the same id, the one loaded last (a map-side maximum, so a key with many rows is no hot window)."""
    rows = read_table(spark, folder, "corpus_document", "id", "text", "loaded_at")
    return rows.groupBy("id").agg(F.max(F.struct("loaded_at", "text")).alias("m")).select("id", "m.text", "m.loaded_at")


@query(f"select id from {DOCS} where regexp_replace(coalesce(license, ''), {q(f'[{C.WS}]+')}, '', 'g') <> ''")
def licensed(spark, folder):
    return docs(spark, folder, "id", "license").where(U.trim_ws(F.coalesce("license", F.lit(""))) != "").select("id")


_CLUSTERS = f"(select item_id, regexp_extract_all(input, {q(C.KCC)}) as a, regexp_extract_all(expected, {q(C.KCC)}) as b from benchmark_case)"
_SHINGLES = "(case when len({0}) = 0 then [] when len({0}) < 2 then [array_to_string({0}, '')] else list_distinct([array_to_string({0}[i:i+1], '') for i in generate_series(1, len({0}) - 1)]) end)"


@query(f"select item_id, round(case when len(list_distinct(x || y)) = 0 then 1.0 else len(list_intersect(x, y)) / len(list_distinct(x || y))::double end, 6) as jaccard from (select item_id, {_SHINGLES.format('a')} as x, {_SHINGLES.format('b')} as y from {_CLUSTERS})")
def shingle_jaccard(spark, folder):
    rows = read_table(spark, folder, "benchmark_case", "item_id", "input", "expected").select("item_id", U.shingles("input", 2).alias("a"), U.shingles("expected", 2).alias("b"))
    return rows.select("item_id", F.round(U.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


# --- tokenizers -------------------------------------------------------------------------------------------------------


@query("select token, count(*) as n from (select unnest(regexp_extract_all(text, '(?s).')) as token from (select distinct id, text from corpus_document)) group by token order by n desc, token limit 96")
def character_vocabulary(spark, folder):
    return docs(spark, folder, "id", "text").select(F.explode(U.characters("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(96)


def _vocabulary_sql(rows: str, most: int) -> str:
    """Ids of the most frequent clusters of ``rows`` (text), ties to the one seen first in the order of texts, as a map."""
    seen = f"select text, generate_subscripts(g, 1) as p, unnest(g) as c from (select text, regexp_extract_all(text, {q(C.KCC)}) as g from {rows})"
    ranked = f"select c, row_number() over (order by n desc, t, p) as r from (select c, n, m.t as t, m.p as p from (select c, count(*) as n, min({{'t': text, 'p': p}}) as m from ({seen}) group by c))"
    return f"(select map(list(c), list(r + 3)) as m from ({ranked}) where r <= {most})"


def _ids_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(C.KCC)}), lambda x: coalesce(v.m[x], 1)::int)"


@query(f"select id, ids, round(coalesce(len(list_filter(ids, lambda i: i = 1)) / nullif(len(ids), 0)::double, 0.0), 6) as unknown from (select id, {_ids_sql('text')} as ids from {DOCS}, {_vocabulary_sql(DOCS, 496)} v)")
def grapheme_encoding(spark, folder):
    rows = docs(spark, folder, "id", "text")
    tokenizer = tokenizers.GraphemeTokenizer().train(rows, vocab_size=500)
    return rows.select("id", tokenizer.ids(F.col("text")).alias("ids"), F.round(tokenizer.unknown_rate(F.col("text")), 6).alias("unknown"))


def _corpus_words(spark: SparkSession, folder: str) -> DataFrame:
    """All words of all documents, as a corpus for tokenizers that learn pieces within words."""
    return docs(spark, folder, "id", "text").select(F.explode(U.words("text")).alias("word"))


@query()
def bpe_tokens(spark, folder):
    tokenizer = tokenizers.BPETokenizer().train(_corpus_words(spark, folder), "word", vocab_size=1500)
    return docs(spark, folder, "id", "text").select("id", F.size(tokenizer.pieces(F.col("text"))).alias("tokens"))


@query()
def unigram_tokens(spark, folder):
    tokenizer = tokenizers.UnigramTokenizer().train(_corpus_words(spark, folder), "word", vocab_size=2000, seed_multiplier=3, em_iterations=1, max_rounds=6)
    return docs(spark, folder, "id", "text").select("id", F.size(tokenizer.pieces(F.col("text"))).alias("tokens"))


@query()
def tokenizer_comparison(spark, folder):
    sample = spark.createDataFrame(list(enumerate(tokenizers.SAMPLE)), "id bigint, text string")
    return tokenizers.compare({n: k() for n, k in tokenizers.KINDS.items()}, sample, vocab_size=100)


# --- lexicon, grammar -------------------------------------------------------------------------------------------------


@query("select word, sum(case when text is null then 0 else (length(text) - length(replace(text, word, ''))) / length(word) end)::bigint as count from lexicon left join (select distinct id, text from corpus_document) d on contains(d.text, word) group by word")
def lexicon_frequency(spark, folder):
    return lexicon.word_frequencies(read_table(spark, folder, "lexicon", "word"), docs(spark, folder, "id", "text"))


# One step per cluster: the best states of the last positions (score, words, words in Khmer, those of the lexicon).
_PATHS = f"""with recursive lex as (select word, ln((count + 1) / (select (sum(count) + count(*))::double from lexicon)) as p, len(regexp_extract_all(word, {q(C.KCC)})) as n from lexicon),
    known as (select map(list(word), list(p)) as m, max(n) as most from lex),
    texts as (select id, regexp_extract_all(text, {q(C.KCC)}) as g from {DOCS} where text is not null),
    walk(id, i, w) as (select id, 0, [{{'s': 0.0::double, 'l': 0::bigint, 'words': 0, 'khmer': 0, 'known': 0}}] from texts
        union all select id, i + 1, list_append(w, list_max(list_filter(list_transform(range(1, least(most, i + 1) + 1), lambda l:
            {{'s': w[len(w) - l + 1].s + coalesce(m[array_to_string(g[i + 2 - l:i + 1], '')], case when l = 1 then {lexicon.UNKNOWN_LOGPROB} end), 'l': l::bigint, 'words': w[len(w) - l + 1].words + 1,
              'khmer': w[len(w) - l + 1].khmer + (case when regexp_matches(array_to_string(g[i + 2 - l:i + 1], ''), {q(C.ANY_KHMER)}) then 1 else 0 end),
              'known': w[len(w) - l + 1].known + (case when regexp_matches(array_to_string(g[i + 2 - l:i + 1], ''), {q(C.ANY_KHMER)}) and m[array_to_string(g[i + 2 - l:i + 1], '')] is not null then 1 else 0 end)}}), lambda x: x.s is not null)))[greatest(1, len(w) + 2 - most::int):]
        from walk join texts using (id), known where i < len(g))
    select id, last.words as words, round(case when last.khmer = 0 then 0.0 else last.known / last.khmer::double end, 6) as coverage, last.khmer - last.known as unknown from (select id, w[len(w)] as last from walk join texts using (id) where i = len(g))"""


@query(_PATHS)
def word_segmentation(spark, folder):
    words = lexicon.Segmenter(lexicon.Lexicon(read_table(spark, folder, "lexicon", "word", "pos", "count"))).words("text")
    rows = (docs(spark, folder, "id", "text").where("text is not null")).select("id", words.alias("w"))
    return rows.select("id", F.size("w").alias("words"), F.round(lexicon.coverage(F.col("w")), 6).alias("coverage"), F.size(lexicon.unknown_words(F.col("w"))).alias("unknown"))


_CUT = "list_distinct([array_to_string({0}[1:i-1] || {0}[i+1:], '') for i in generate_series(1, len({0}))])"
_SPELL = f"""with lex as (select word, count, regexp_extract_all(word, {q(C.KCC)}) as g from lexicon),
    asked as (select distinct w as word from (select unnest(regexp_extract_all(text, {q(C.WORD)}, 1)) as w from {DOCS}) where regexp_matches(w, {q(C.ANY_KHMER)})),
    rest as (select word, regexp_extract_all(word, {q(C.KCC)}) as g from asked where word not in (select word from lex)),
    cut as (select word, unnest({_CUT.format('g')}) as v from rest where len(g) >= 2),
    lexcut as (select word, count, unnest({_CUT.format('g')}) as v from lex where len(g) >= 2),
    found as (select distinct * from (select c.word as query, l.word, l.count from cut c join lex l on c.v = l.word union all select r.word, l.word, l.count from rest r join lexcut l on r.word = l.v where len(r.g) >= 2 union all select c.word, l.word, l.count from cut c join lexcut l on c.v = l.v) where query <> word),
    scored as (select f.*, (select coalesce(min(i) - 1, least(len(a.g), len(b.g))) from (select unnest(generate_series(1, least(len(a.g), len(b.g)))) as i) where a.g[i] <> b.g[i]) as prefix from found f join rest a on a.word = f.query join lex b on b.word = f.word),
    best as (select query, list(word order by prefix desc, count desc, word)[1:3] as suggestions from scored group by query)
    select word, 'CORRECT' as verdict, []::varchar[] as suggestions from asked where word in (select word from lex)
    union all select r.word, case when b.query is null then 'UNKNOWN' else 'MISSPELLED' end, coalesce(b.suggestions, []::varchar[]) from rest r left join best b on b.query = r.word"""


@query(_SPELL)
def spelling(spark, folder):
    table = read_table(spark, folder, "lexicon", "word", "pos", "count")
    asked = docs(spark, folder, "id", "text").select(F.explode(U.words("text")).alias("word")).where(F.col("word").rlike(C.ANY_KHMER)).distinct()
    return lexicon.check_words(asked, table)


@query(f"select word, unnest(list_distinct([array_to_string(g[1:i-1] || g[i+1:], '') for i in generate_series(1, len(g))])) as variant from (select word, regexp_extract_all(word, {q(C.KCC)}) as g from lexicon)")
def spelling_variants(spark, folder):
    return read_table(spark, folder, "lexicon", "word").select("word", F.explode(lexicon.deletions(F.col("word"))).alias("variant"))


@query(f"with c as (select c as token, count(*) as n from {_RUNS} group by c) select token, n as count, round(pow(n, 0.75) / sum(pow(n, 0.75)) over (), 8) as noise from c")
def noise_distribution(spark, folder):
    made = embeddings.vocabulary(docs(spark, folder, "id", "text"), tokenizers.GraphemeTokenizer())
    return made.select("token", "count", F.round("noise", 8).alias("noise"))


def _markers_sql() -> str:
    """Occurrences of function words in ``sentence``, without buried ones, longest first, as a list of structs."""
    table = sorted(grammar.FUNCTION_WORDS, key=lambda w: -len(w[0]))
    places = "list_filter(range(length(sentence)), lambda i: substr(sentence, i + 1, {n}) = {w})"
    each = [f"list_transform({places.format(n=len(w), w=q(w))}, lambda i: {{'w': {q(w)}, 'k': '{k}', 'i': i, 'l': {len(w)}}})" for w, k, _ in table]
    content = ", ".join(f"list_transform({places.format(n=len(w), w=q(w))}, lambda i: {{'s': i, 'n': {len(w)}}})" for w in grammar.CONTENT_WORDS)
    buried = f"len(list_filter(flatten([{content}]), lambda b: b.s <= m.i and m.i + m.l <= b.s + b.n and b.n > m.l)) > 0"
    placed = f"(m.w <> 'ទេ' or regexp_matches(substr(sentence, m.i + m.l + 1), {q(grammar.CLAUSE_END)}))"
    found = f"list_filter(flatten([{', '.join(each)}]), lambda m: not ({buried}) and {placed})"
    return found


_TAKEN = "list_reduce(list_transform(f, lambda m: [m]), lambda a, b: case when len(list_filter(a, lambda t: t.i <= b[1].i and b[1].i < t.i + t.l)) > 0 then a else a || b end, f[1:0])"


_SENTENCES = f"(select s as sentence from (select {TRIM} as s from (select unnest(regexp_extract_all(text, {q(C.SENTENCE)})) as s from {DOCS})) where s <> '')"
_HAS = "list_bool_or(list_transform(m, lambda t: t.w in ({})))"
_FEATURES = f"""select case when {_HAS.format("'នឹង'")} then 'future?' when {_HAS.format("'បាន'")} then 'past' else 'unmarked' end as tense,
    case when {_HAS.format("'កំពុង'")} then 'continuous' when {_HAS.format("'ហើយ'")} then 'perfective' when {_HAS.format("'ធ្លាប់'")} then 'experiential' else 'unmarked' end as aspect,
    coalesce({_HAS.format("'មិន', 'ឥត', 'ពុំ'")}, false) as is_negated,
    ends_with(sentence, '?') or coalesce(list_bool_or(list_transform(m, lambda t: t.k = 'QUESTION')), false) or (ends_with(regexp_replace(sentence, '[។៕]+$', ''), 'ទេ') and not coalesce({_HAS.format("'មិន', 'ឥត', 'ពុំ'")}, false)) as is_question,
    case when len(m) = 0 then 1.0 else least(1.0, list_sum(list_transform(m, lambda t: t.l)) / len(m)::double / 4.0) end as confidence
    from (select sentence, {_TAKEN} as m from (select sentence, {_markers_sql()} as f from {_SENTENCES}))"""


@query(f"select tense, aspect, is_question, is_negated, count(*) as sentences, round(avg(confidence), 6) as confidence from ({_FEATURES}) group by all")
def grammar_features(spark, folder):
    rows = grammar.analyze_text((docs(spark, folder, "id", "text")), "id")
    return rows.groupBy("tense", "aspect", "is_question", "is_negated").agg(F.count(F.lit(1)).alias("sentences"), F.round(F.avg("confidence"), 6).alias("confidence"))


# --- sources: written to the shared folder and read again ---------------------------------------------------------------


@query("select distinct id, text, source, license, coalesce(domain, 'general') as domain, coalesce(language, 'km') as language, quality, coalesce(cardinality(metadata), 0)::int as entries from corpus_document where quality is null or not isnan(quality)")
def documents_json(spark, folder):
    rows = read_table(spark, folder, "corpus_document", "id", "text", "source", "license", "domain", "language", "quality", "metadata").where("quality is null or not isnan(quality)")
    io.write_documents(rows, path := scratch(spark, "documents"))
    made = io.read_documents(spark, path)
    return made.select("id", "text", "source", "license", "domain", "language", "quality", F.size("metadata").alias("entries")).distinct()


def _full_sql(column: str) -> str:
    """A column without white space at its ends."""
    return f"regexp_replace({column}, {q(f'\\A[{C.WS}]+|[{C.WS}]+\\z')}, '', 'g')"


def _with_comments(rows: DataFrame, *columns: str) -> DataFrame:
    """JSON lines of some columns, between comments and blank lines."""
    return rows.select(F.concat(F.lit("# a note\n\n"), F.to_json(F.struct(*columns)), F.lit("\n")).alias("value"))


@query(f"select {_full_sql('category')} as category, input, expected, coalesce(note, '') as note from benchmark_case where {_full_sql('category')} <> '' and {_full_sql('expected')} <> ''")
def cases_json(spark, folder):
    rows = read_table(spark, folder, "benchmark_case", "category", "input", "expected", "note").where((U.trim_ws("category") != "") & (U.trim_ws("expected") != ""))
    _with_comments(rows, "category", "input", "expected", "note").write.text(path := scratch(spark, "cases"))
    return io.read_cases(spark, path)


@query(f"select instruction, output, coalesce(input, '') as input from instruction_example where {_full_sql('instruction')} <> '' and {_full_sql('output')} <> ''")
def instructions_json(spark, folder):
    rows = read_table(spark, folder, "instruction_example", "instruction", "output", "input").where((U.trim_ws("instruction") != "") & (U.trim_ws("output") != ""))
    _with_comments(rows, "instruction", "output", "input").write.text(path := scratch(spark, "instructions"))
    return io.read_instructions(spark, path).select("instruction", "output", "input")


@query("select word, coalesce(pos, 'unknown') as pos, coalesce(count, 0) as count from lexicon")
def lexicon_json(spark, folder):
    io.write_lexicon(read_table(spark, folder, "lexicon", "word", "pos", "count"), path := scratch(spark, "lexicon"))
    return io.read_lexicon(spark, path)


@query(f"select {_full_sql('title')} as title, length(text)::int as letters from wiki_page where {_full_sql('ns')} = '0' and {_full_sql('title')} <> '' and {_full_sql("coalesce(text, '')")} <> '' and not regexp_matches(text, {q(REDIRECT)})")
def dump_pages(spark, folder):
    """The pages as a dump in XML, read again as the corpus builder reads it."""
    rows = read_table(spark, folder, "wiki_page", "title", "ns", "text")
    pages = rows.select("title", "ns", F.struct(F.struct(F.col("text").alias("_VALUE")).alias("text")).alias("revision"))
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path := scratch(spark, "dump"))
    return io.read_pages(spark, path).select("title", F.char_length("text").alias("letters"))


# --- evaluation -------------------------------------------------------------------------------------------------------


@query("select category, count(*) as n from benchmark_case group by category")
def case_counts(spark, folder):
    return evaluate.case_counts(read_table(spark, folder, "benchmark_case", "category"))


@query("select category, count(*) as cases, round(avg(case when expected = input then 1.0 else 0.0 end), 6) as exact_match, round(avg(case when contains(input, trim(expected)) then 1.0 else 0.0 end), 6) as contains from benchmark_case group by rollup (category)")
def benchmark_echo(spark, folder):
    results = evaluate.run_benchmark(read_table(spark, folder, "benchmark_case", "item_id", "category", "input", "expected"), F.col("input"))
    return evaluate.category_scores(results).select("category", "cases", F.round("exact_match", 6).alias("exact_match"), F.round("contains", 6).alias("contains"))


def _rate_sql(pattern: str, name: str) -> str:
    """Edits per unit of the input: each unit of a pair is written as one of 127 signs (no pair has more), which the
    byte-wise edit distance of the SQL engine compares."""
    a, b = (f"regexp_extract_all({c}, {q(pattern)}) as {x}" for x, c in (("a", "input"), ("b", "expected")))
    x, y = (f"array_to_string(list_transform({c}, lambda k: chr(list_position(u, k)::int)), '')" for c in "ab")
    return f"(select item_id, round(case when len(a) = 0 then (case when len(b) = 0 then 0.0 else 1.0 end) else levenshtein({x}, {y}) / len(a)::double end, 6) as {name} from (select item_id, a, b, list_distinct(a || b) as u from (select item_id, {a}, {b} from benchmark_case)))"


@query(f"select item_id, cer, ger from {_rate_sql('(?s).', 'cer')} join {_rate_sql(C.KCC, 'ger')} using (item_id)")
def error_rates(spark, folder):
    rows = read_table(spark, folder, "benchmark_case", "item_id", "input", "expected")
    return rows.select("item_id", F.round(evaluate.character_error_rate("input", "expected"), 6).alias("cer"), F.round(evaluate.grapheme_error_rate("input", "expected"), 6).alias("ger"))


_GRAMS = f"(select item_id, unnest([array_to_string(g[i:i+2], '|') for i in generate_series(1, len(g) - 2)]) as gram from (select item_id, regexp_extract_all(input, {q(C.KCC)}) as g from benchmark_case))"
_CORPUS_GRAMS = f"(select distinct unnest([array_to_string(g[i:i+2], '|') for i in generate_series(1, len(g) - 2)]) as gram from (select regexp_extract_all(text, {q(C.KCC)}) as g from {DOCS}))"


@query(f"select item_id, count(*) as total, count(c.gram) as attested from {_GRAMS} b left join {_CORPUS_GRAMS} c on b.gram = c.gram group by item_id")
def ngram_grounding(spark, folder):
    index = evaluate.Grounding(docs(spark, folder, "id", "text"), orders=(3,))
    return index.score(read_table(spark, folder, "benchmark_case", "item_id", "input"), "item_id", "input").select("item_id", "total", "attested")


@query(f"select id, round(case when n < 2 then 0.0 else len(list_distinct([g[i:i+1] for i in generate_series(1, n - 1)])) / (n - 1)::double end, 6) as distinct_2 from {_FIVE}")
def distinct_bigrams(spark, folder):
    return docs(spark, folder, "id", "text").where("text is not null").select("id", F.round(U.distinct_n("text", 2), 6).alias("distinct_2"))


@query(f"select d.id, coalesce(max(n), 0) as run from (select id from {DOCS} where text is not null) d left join (select id, count(*) as n from (select id, c, i - row_number() over (partition by id, c order by i) as island from {_RUNS}) group by id, c, island) r on d.id = r.id group by d.id")
def longest_runs(spark, folder):
    return docs(spark, folder, "id", "text").where("text is not null").select("id", U.longest_run("text").alias("run"))


_OUTPUTS = "(select distinct example_id, coalesce(output, '') as text from instruction_example)"
_LONGEST = f"(select example_id, max(n) as run from (select example_id, count(*) as n from (select example_id, c, i - row_number() over (partition by example_id, c order by i) as island from (select example_id, generate_subscripts(g, 1) as i, unnest(g) as c from (select example_id, regexp_extract_all(text, {q(C.KCC)}) as g from {_OUTPUTS}))) group by example_id, c, island) group by example_id)"
_VERDICTS = f"select o.example_id, {ERRORS} = 0 as a, {RATIO} >= 0.5 as b, coalesce(run, 0) <= 5 as c from {_OUTPUTS} o left join {_LONGEST} r on o.example_id = r.example_id"


@query(f"select example_id, a and b and c as passed, '3/7 checks implemented' as coverage, [case when a then 'PASS' else 'FAIL' end, case when b then 'PASS' else 'FAIL' end, case when c then 'PASS' else 'FAIL' end, 'UNAVAILABLE', 'UNAVAILABLE', 'UNAVAILABLE', 'UNAVAILABLE'] as statuses from ({_VERDICTS})")
def output_checks(spark, folder):
    rows = evaluate.analyze_outputs(spread(read_table(spark, folder, "instruction_example", "example_id", "output").distinct()), "example_id", "output")
    return rows.select("example_id", "passed", "coverage", F.transform("checks", lambda c: c["status"]).alias("statuses"))


# --- embeddings, language model ---------------------------------------------------------------------------------------


@query("with v as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as query, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 6) as cosine, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.e, b.e) desc, b.vec_id) as r from v a, v b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) select query, neighbour, cosine from s where r <= 5")
def cosine_top(spark, folder):
    vectors = read_table(spark, folder, "embeddings", "vec_id", "embedding")
    return embeddings.cosine_top(vectors.where("vec_id % 50 = 0"), vectors).select("query", "neighbour", F.round("cosine", 6).alias("cosine"))


@query(f"with t as (select id, i, c from {_RUNS}) select a.c as center, b.c as context, count(*) as n from t a join t b on a.id = b.id and b.i between a.i - 2 and a.i + 2 and a.i <> b.i group by a.c, b.c")
def skipgram_pairs(spark, folder):
    pairs = embeddings.training_pairs(docs(spark, folder, "id", "text"), tokenizers.GraphemeTokenizer(), "id")
    return pairs.groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))


@query()
def word_vectors(spark, folder):
    model = embeddings.Word2Vec(tokenizers.GraphemeTokenizer(), dim=16, min_count=2)
    model.train(docs(spark, folder, "id", "text"), "id", epochs=2)
    return model.table(spark)


@query("select example_id, '### សំណួរ:' || chr(10) || instruction || (case when coalesce(input, '') = '' then '' else chr(10) || input end) || chr(10) || chr(10) || '### ចម្លើយ:' || chr(10) as prompt from (select distinct example_id, instruction, input from instruction_example) where instruction is not null")
def instruction_prompts(spark, folder):
    rows = read_table(spark, folder, "instruction_example", "example_id", "instruction", "input").distinct().where("instruction is not null")
    return rows.select("example_id", lm.format_prompt("instruction", "input").alias("prompt"))


_ASKED = "('### សំណួរ:' || chr(10) || instruction || (case when coalesce(input, '') = '' then '' else chr(10) || input end) || chr(10) || chr(10) || '### ចម្លើយ:' || chr(10))"
_PAIRS = "(select distinct example_id, instruction, input, output from instruction_example)"
_CODED = f"(select example_id, len({_ids_sql(_ASKED)}) as p, list_append({_ids_sql(f'{_ASKED} || output')}, 3) as ids from {_PAIRS} e, {_vocabulary_sql('(select output as text from ' + _PAIRS + ')', 396)} v where instruction is not null and output is not null)"


@query(f"select example_id, ids, list_transform(range(len(ids) - 1), lambda i: (case when i < greatest(p - 1, 0) then 0 else 1 end)::int) as mask from {_CODED} where len(ids) >= 2 and p < len(ids) and len(ids) <= 512")
def instruction_encoding(spark, folder):
    rows = read_table(spark, folder, "instruction_example", "example_id", "instruction", "input", "output").distinct()
    tokenizer = tokenizers.GraphemeTokenizer().train(rows, "output", vocab_size=400)
    return lm.encode_examples(rows, tokenizer, 512)


@query("select window_no, min(p) as first, count(*) as tokens from (select floor(p / 32)::bigint as window_no, p from (select unnest(generate_series(0, n - 2)) as p from (select sum(length(text))::bigint as n from lang_sample))) group by window_no having count(*) = 32")
def token_windows(spark, folder):
    rows = read_table(spark, folder, "lang_sample", "sample_id", "text")
    tokenizer = tokenizers.CharacterTokenizer().train(rows, vocab_size=300)
    made = evaluate.windows(lm.token_stream(rows, tokenizer, "sample_id"), 32)
    return made.select(F.col("window").alias("window_no"), (F.col("window") * 32).alias("first"), F.size("inputs").cast("bigint").alias("tokens"))


@query(f"select * from (values {values(*C.character_records())}) t(codepoint, codepoint_hex, char, name, type, series, romanization, romanization_o, ipa, ipa_o, place, value)")
def characters(spark, folder):
    return C.characters(spark)


@query(f"select * from (values {values(*((w, k, g, w in grammar.CLAUSE_FINAL, grammar.AMBIGUOUS.get(w)) for w, k, g in grammar.FUNCTION_WORDS))}) t(word, class, gloss, clause_final_only, ambiguous_with)")
def function_words(spark, folder):
    return grammar.function_words(spark)
