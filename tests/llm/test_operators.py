"""The nine operators against brute force, round trips and held-out accuracy, and on odd tables."""

import pickle
import random
import time
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F


from borei.llm import confusables, encode, folding, langid, leaks, markup, overlap, pairs, queries, sentences, spam
from borei.llm._text import table_sums

TIMES = "timestamp'2024-01-01 00:00:00'"


@pytest.fixture(scope="module")
def samples(spark, smallest):
    return spark.read.parquet(f"{smallest}/lang_sample.parquet").toPandas()


@pytest.fixture(scope="module")
def model(samples):
    return langid.LanguageModel.fit(samples.text.tolist(), samples.lang.tolist())


def texts(spark, folder, table, column="text"):
    return [r[0] for r in spark.read.parquet(f"{folder}/{table}.parquet").select(column).collect()]


# --- 1 ----------------------------------------------------------------------------------------------------------------


def test_languages_held_out(samples):
    right = 0
    for fold in range(4):
        rest, held = samples[samples.index % 4 != fold], samples[samples.index % 4 == fold]
        fitted = langid.LanguageModel.fit(rest.text.tolist(), rest.lang.tolist())
        right += sum(len(s) == 1 and s[0][2] == x for s, x in zip(langid.detect(held.text.tolist(), fitted), held.lang, strict=True))
    assert right >= 0.98 * len(samples)


def test_mixed_texts_fall_into_their_segments(samples, model):
    rng = random.Random(5)
    by = {lang: g[g.text.str.len() > 90].text.tolist() for lang, g in samples.groupby("lang") if lang != "zh"}
    right = 0
    for _ in range(60):
        a, b = rng.sample(sorted(by), 2)
        text = rng.choice(by[a]) + "\n" + rng.choice(by[b])
        right += [s[2] for s in langid.detect([text], model)[0]] == [a, b]
    assert right >= 57


def test_segments_cover_the_text_and_short_ones_join(model):
    text = "The village of Belkar sold every lamp (សៀវភៅ) to the people of Rouzu when the rain was old."
    (found,) = langid.detect([text], model)
    assert [(s[0], s[1], s[2]) for s in found] == [(0, len(text), "en")] and 0.9 < found[0][3] <= 1
    wide = "Ｔｈｅ ｐｅｏｐｌｅ of the village sold every lamp and the old house beside the river in 1903."
    assert langid.detect([wide, unicodedata.normalize("NFD", "Không ai ở đây biết vì sao họ đã bán quyển sách cũ của làng này."), "", None, " 12 ", "1"], model)[1:] and langid.detect([wide], model)[0][0][2] == "en"
    assert langid.detect(["", None, " 12 "], model) == [[], [], []]


def test_short_stretches_in_long_texts_are_found(samples, model):
    """Wherever a stretch lies that is found in a text of fewer words."""
    words = {lang: " ".join(g.text).split() for lang, g in samples.groupby("lang")}
    en, tried = words["en"], 0
    for lang in ("fr", "id"):
        for k in range(0, 200, 10):
            stretch = words[lang][k : k + 10]
            inner = en[:19] + stretch + en[19:38]
            if [s[2] for s in langid.detect([" ".join(inner)], model)[0]] != ["en", lang, "en"]:
                continue
            tried += 1
            for at in range(12):
                text = " ".join(en[100 : 112 + at] + inner + en[38:90])
                assert [s[2] for s in langid.detect([text], model)[0]] == ["en", lang, "en"], (lang, k, at)
    assert tried > 3


def brute_merge(parts, least):
    """The shortest part below the bound goes to its longer neighbour, again and again."""

    def joined(items):
        out = []
        for p in items:
            if out and out[-1][2] == p[2]:
                out[-1] = [out[-1][0], p[1], p[2], out[-1][3] + p[3]]
            else:
                out.append(list(p))
        return out

    parts = joined(parts)
    while len(parts) > 1:
        i = min(range(len(parts)), key=lambda k: parts[k][3])
        if parts[i][3] >= least:
            break
        near = [k for k in (i - 1, i + 1) if 0 <= k < len(parts)]
        parts[i][2] = parts[max(near, key=lambda k: parts[k][3])][2]
        parts = joined(parts)
    return parts


def test_short_segments_join_as_by_the_rule():
    rng = random.Random(2)
    for _ in range(300):
        parts = [[i, i + 1, rng.randrange(4), rng.randrange(0, 90)] for i in range(rng.randrange(1, 15))]
        assert langid._merge([list(p) for p in parts], 50) == brute_merge(parts, 50)


def test_sums_are_the_same_in_any_steps(model):
    cps = np.frombuffer(("The people of ភូមិ sold it. " * 40).encode("utf-32-le"), np.uint32)
    at = np.array([0, 1, 7, 100, 101, 640, len(cps)])
    whole = model.sums_at(cps, at)
    assert np.allclose(whole, model.sums_at(cps, at, 7), atol=1e-3) and np.allclose(whole, model.sums_at(cps, at, 100), atol=1e-3)


@pytest.mark.parametrize(("label", "code"), [("km_KH", "km"), ("Khmer", "km"), ("ខ្មែរ", "km"), ("FR", "fr"), ("français", "fr"), ("chi", "zh"), ("zh-Hant", "zh"), ("Bahasa Indonesia", "id"), ("tiếng Việt", "vi"), ("und", None), ("", None), (None, None), ("n/a", None), ("xx", None)])
def test_labels(label, code):
    assert langid.language_code(label) == code


# --- 2 ----------------------------------------------------------------------------------------------------------------

SAME = [("ＡＢＣ１２", "ABC12"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("ﬁsh", "fish"), ("Kаrѕ", "Kars"), ("⼈", "人"), ("តេី", "តើ"), ("ឣ", "អ"), ("ន្ដ", "ន្ត"), ("រា៉", "រ៉ា"), ("ទេា", "ទោ"), ("co‑op", "co-op"), ("ເເ", "ແ"), ("ํา", "ำ"), ("នំុ", "នុំ"), ("a\r\nb", "a\nb")]
OTHER = [("A", "a"), ("e", "é"), ("1", "១"), ("a b", "a  b"), ("a\nb", "a\n\nb"), ("x²", "x2"), ("cat", "car")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_look_alikes_get_one_form(a, b):
    assert confusables.consistent_form(a) == confusables.consistent_form(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_visible_differences_stay(a, b):
    assert confusables.consistent_form(a) != confusables.consistent_form(b)


def test_tokens_are_resolved_by_script_sets():
    assert confusables.resolve_token("сосо") == ("coco", "whole") and confusables.resolve_token("pасе")[1] == "mixed"
    assert confusables.resolve_token("привет") == ("привет", "single") and confusables.resolve_token("пpивет") == ("привет", "mixed")
    assert confusables.resolve_token("zж")[1] == "tangled"


def test_forms_of_a_batch(spark, smallest):
    rows = texts(spark, smallest, "corpus_document") + texts(spark, smallest, "wiki_page")
    forms = confusables.consistent_forms(rows)
    assert forms == [confusables.consistent_form(t) for t in rows]
    assert [confusables.consistent_form(f) for f in forms] == forms


def test_large_forms_are_joined_in_parts(spark):
    rows = [(f"k{i}", "ASCII text of a lamp" if i % 3 else "АSСII tехt of a lamp") for i in range(60)] + [("x", "other")]
    got = [tuple(r) for r in confusables.look_alike_pairs(spark.createDataFrame(rows, "id string, text string"), "id", part=7).collect()]
    want = {tuple(sorted((a, b))) for (a, x), (b, y) in combinations(rows[:-1], 2) if x != y}
    assert set(got) == want and len(got) == len(want)


def test_look_alikes_of_further_scripts():
    assert confusables.consistent_forms(["ᏢᎪᎳ", "ꓐꓮꓓ", "ⲞⲤⲦ", "ᎯᏎ"]) == ["PAW", "BAD", "OCT", "ᎯᏎ"]


def test_pairs_equal_brute_force(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/corpus_document.parquet")
    rows = [(r.id, r.text, confusables.consistent_form(r.text)) for r in docs.select("id", "text").distinct().collect()]
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations(rows, 2) if a[2] and a[2].strip() and a[2] == b[2] and a[1] != b[1] and a[0] != b[0]}
    got = [tuple(r) for r in confusables.look_alike_pairs(docs, "id").collect()]
    assert set(got) == want and len(got) == len(want)


# --- 3 ----------------------------------------------------------------------------------------------------------------

CASES = [
    ("The end. A start.", ["The end.", "A start."]),
    ("Dr. Bel paid 3.50 coins at 8 a.m. on that day. See No. 5 on p. 3.", ["Dr. Bel paid 3.50 coins at 8 a.m. on that day.", "See No. 5 on p. 3."]),
    ("They sold bells, etc. The rain came.", ["They sold bells, etc.", "The rain came."]),
    ("They sold bells, etc. for Wi. Z. Kar left.", ["They sold bells, etc. for Wi.", "Z. Kar left."]),
    ("Nobody but Tar ... and perhaps Vim ... came.", ["Nobody but Tar ... and perhaps Vim ... came."]),
    ('Bel wrote: "The lamp is old." Then it rained.', ['Bel wrote: "The lamp is old."', "Then it rained."]),
    ('"Where is the lamp?" asked Bel before the song.', ['"Where is the lamp?" asked Bel before the song.']),
    ("« Où est le bois ? » demandait Bel. Fin.", ["« Où est le bois ? » demandait Bel.", "Fin."]),
    ("A heading\n\nText goes\non here. End.", ["A heading", "Text goes\non here.", "End."]),
    ("«តើរឿងនៅឯណា?» ម៉ៅសួរ។តាមលី ៥៣.៥ ដង។", ["«តើរឿងនៅឯណា?» ម៉ៅសួរ។", "តាមលី ៥៣.៥ ដង។"]),
    ("រាប់ផ្លូវ ភូមិ ។ល។ ដែលលីទិញ។ មានត្រី៘ ដែលទិញ។", ["រាប់ផ្លូវ ភូមិ ។ល។ ដែលលីទិញ។", "មានត្រី៘ ដែលទិញ។"]),
    ("ទៅ ៦៦.៨៤ គ.ម. ហើយឆ្លង។", ["ទៅ ៦៦.៨៤ គ.ម. ហើយឆ្លង។"]),
    ("ถนนยาว 14.75 กิโลเมตรและตลาด ดร.พรซื้อวัว", ["ถนนยาว 14.75 กิโลเมตรและตลาด", "ดร.พรซื้อวัว"]),
    ("花园在哪里？“来了。”他说。走了！", ["花园在哪里？", "“来了。”他说。", "走了！"]),
    ("It was (see p. 3. Now) done! Yes", ["It was (see p. 3. Now) done!", "Yes"]),
    ('An "open quote. And more. End', ['An "open quote.', "And more.", "End"]),
    ("12 34", []), ("", []), (None, []), ("។ ។", []),
    ("A one (b (c (d) e) f. Next g) h. Bel", ["A one (b (c (d) e) f. Next g) h.", "Bel"]),
    ("It " + "(" * 10 + "is. Not" + ")" * 9 + " so. But) old. It rained.", ["It " + "(" * 10 + "is. Not" + ")" * 9 + " so. But) old.", "It rained."]),
    ('Bel wrote: "The lamp is old' + "." * 30 + '" Then it rained.', ['Bel wrote: "The lamp is old' + "." * 30 + '"', "Then it rained."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_sentences(text, want):
    (found,) = sentences.sentences([text])
    assert [text[a:b] for a, b in found] == want


def test_scan_equals_one_step_at_a_time():
    step, ends = sentences._machine()
    events = np.random.default_rng(0).integers(0, sentences.EVENTS, 5001)
    state, depth, want = 0, 0, []
    for e in events:
        want.append(bool(ends[state, e]) and (depth == 0 or e == sentences.RESET))
        state = step[state, e]
        depth = 0 if e == sentences.RESET else max(0, depth + (e == sentences.LEFT) - (e == sentences.RIGHT))
    for block in (1, 7, 64, 9000):
        assert sentences.run_machine(events, block).tolist() == want


def test_texts_of_a_batch_are_independent(spark, smallest):
    rows = texts(spark, smallest, "corpus_document")
    assert sentences.sentences(rows) == [sentences.sentences([t])[0] for t in rows]


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_defects(model, spark, smallest):
    inputs = [t for t in texts(spark, smallest, "instruction_example", "input") if t] * 5
    occurs, ends = np.zeros(1 << pairs.END_BITS), np.zeros(1 << pairs.END_BITS)
    pairs.EndModel.count([t for t in inputs if len(t) > 40], occurs, ends)
    rows = [
        ("Explain how the lamp is kept in Belkar", None, "N/A", "empty"), ("Where?", "", " ... ", "empty"), ("Where?", "", None, "empty"), ("Where?", "", "​", "empty"),
        ("Explain the lamp of Belkar", "", "I'm sorry, but I cannot help with that.", "refusal"), ("តើណា?", "", "ខ្ញុំមិនអាចឆ្លើយសំណួរនេះបានទេ។", "refusal"),
        ("Explain the lamp of Belkar", "", "Sorry weather closed the road, so Bel refuses to pay the toll.", None),
        ("Who founded the lamp at Thodol?", "", "WHO FOUNDED THE LAMP AT THODOL", "copy"), ("Who founded the lamp at Thodol?", "", "Question: Who founded the lamp at Thodol?", "copy"),
        ("Who founded the lamp at Thodol?", "", "Who founded the lamp at Thodol? Belkar of Wi.", None), ("Traduisez ce mot en anglais", "village", "village", None),
        ("Explain how the lamp is kept in Belkar", "", "Personne à Bel ne sait pourquoi le village était célèbre et vieux.", "other_language"),
        ("បកប្រែពាក្យនេះទៅជាភាសាវៀតណាម", "ត្នោត", "cây thốt nốt và khu vườn", None), ("In which district does Leklom lie?", "", "Zusa", None),
        ("Explain how the lamp is kept in Belkar", "", "People have kept the lamp since 1948. In 1814 the peop", "truncated"), ("List three places near Lom", "", "- Bel\n- Kar\n- ", "truncated"),
        ("List three places near Lom", "", "- Bel\n- Kar\n- Wi", None), ("Explain how the lamp is kept in Belkar", "", "People have kept the lamp since 1948. It was sold…", "truncated"), ("How many?", "", "42", None),
    ]
    got = pairs.defects([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], model, pairs.EndModel(occurs, ends))
    assert [(r[2], g) for r, g in zip(rows, got, strict=True)] == [(r[2], r[3]) for r in rows]


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_edit_distance():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *[0] * len(b)] if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        return new

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcក") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert overlap.edit_distance(a, b) == brute(a, b)


def test_difference_ignores_form_and_order():
    a = "The lamp of Bel was old. In 1903 the people of Kar sold it. Every house needs a blue door."
    assert overlap.difference(a, "EVERY HOUSE NEEDS A BLUE DOOR!\nthe lamp of bel was old - in 1903 the people of Kаr sold it") == 0
    assert overlap.difference(a, a.replace("1903", "1904")) < 0.05 and overlap.difference(a, a[:45]) > 0.3 and overlap.difference("", "") == 1.0


def test_overlaps_equal_brute_force(spark, smallest):
    records = spark.read.parquet(f"{smallest}/corpus_split.parquet")
    rows = records.select("rec_id", "split", "text").distinct().collect()
    held, train = [r for r in rows if r.split != "train" and r.text], [r for r in rows if r.split == "train" and r.text]
    want = {(a.rec_id, b.rec_id) for a in held for b in train if overlap.difference(a.text, b.text) < overlap.DIFFER}
    got = [(r.eval_id, r.train_id) for r in overlap.cross_split_overlaps(records).collect()]
    assert set(got) == want and len(got) == len(want)


def test_short_and_repeated_records(spark):
    rows = [(1, "train", "abc"), (2, "test", "ABC!"), (3, "train", None), (4, "validation", ""), (5, "train", "short text here"), (6, "test", "short text here"), (7, "other", "short text here"), (6, "test", "short text here")] + [(100 + i, "train", "one text of which there are many copies in the corpus") for i in range(50)] + [(200, "test", "One text, of which there are many copies in the corpus")]
    got = overlap.cross_split_overlaps(spark.createDataFrame(rows, "rec_id bigint, split string, text string"))
    pairs_ = sorted((r.eval_id, r.train_id) for r in got.collect())
    assert pairs_ == [(2, 1), (6, 5), *[(200, 100 + i) for i in range(50)]]


def test_long_texts_have_an_edit_distance_too():
    rng = random.Random(1)
    text = "".join(rng.choice("aeioulmnprst") for _ in range(25_000))
    assert overlap.difference(text, "".join("x" if rng.random() < 0.06 else c for c in text)) < 0.07
    assert overlap.difference(text, "".join("x" if rng.random() < 0.15 else c for c in text)) > 0.1


def edited(rng, text, edits):
    out = list(text)
    for k in sorted(rng.sample(range(len(out)), edits), reverse=True):
        kind = rng.randrange(3)
        out[k : k + 1] = [] if kind == 0 else [rng.choice("bcdfghjk")] if kind == 1 else [out[k], rng.choice("bcdfghjk")]
    return "".join(out)


def test_scattered_edits_are_found(spark):
    """Edits of 5 to 9 % spread over short and long texts, against all pairs."""
    rng, rows = random.Random(8), []
    for size in [*range(5, 80), *[100, 150, 300, 400, 700, 1500] * 6]:
        text = "".join(rng.choice("aeioulmnprst") for _ in range(size))
        step = max(1, size // max(1, int(size * rng.uniform(0.05, 0.09))))
        even = "".join("x" if k % step == step - 1 else c for k, c in enumerate(text))  # the same distance apart
        k = 10 * len(rows)
        rows += [(k + 1, "train", text), (k + 2, "test", edited(rng, text, int(size * rng.uniform(0.05, 0.09)))), (k + 3, "validation", even)]
    held, train = [r for r in rows if r[1] != "train"], [r for r in rows if r[1] == "train"]
    want = {(a[0], b[0]) for a in held for b in train if abs(len(a[2]) - len(b[2])) < 0.12 * max(len(a[2]), len(b[2])) and overlap.difference(a[2], b[2]) < overlap.DIFFER}
    got = [(r.eval_id, r.train_id) for r in overlap.cross_split_overlaps(spark.createDataFrame(rows, "rec_id bigint, split string, text string")).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 150


def test_texts_of_few_phrases_rarely_meet(spark):
    """Texts that share their phrases and differ in names: what meets in vain grows with the square of the records."""
    rng, rows = random.Random(4), []
    name = lambda: "".join(rng.choice("kgstpnmrlvz") + rng.choice("aeiou") for _ in range(rng.randint(3, 5)))
    phrases = ["nobody but {0} knows why {1} {2} the {3}", "the road to {0} passes a {2} of {1}", "according to {0} the {2} book is kept in {1}", "after the {2} {0} went back to {1} with a {3}", "{0} {3} everything in the {2} beside {1}", "in {1} the people and {0} have {3} the {2}"]
    words = [name() + name() for _ in range(60)]
    for k in range(1200):
        rows.append((k, "test" if k % 4 == 0 else "train", ". ".join(rng.choice(phrases).format(name(), name(), rng.choice(words), rng.choice(words)) for _ in range(6))))
    rows += [(2000 + k, "train", edited(rng, rows[4 * k][2], 9)) for k in range(60)]
    records = spark.createDataFrame(rows, "_id bigint, split string, _text string").selectExpr("_id", "cast(if(split = 'train', 2, 1) as tinyint) as side", "_text", "unhex(md5(cast(_text as binary))) as cls").cache()
    shared = spark.sparkContext.broadcast(overlap.known(records))
    held, train = (overlap.offers(records.where(f"side = {side}"), shared, side == 2).cache() for side in (1, 2))
    met = {(r.eval_rep, r.train_rep) for r in overlap.meetings(held, train).collect()}
    assert {(4 * k, 2000 + k) for k in range(60)} <= met and len(met) < 700
    often = [d.where(f"(m & {1 << 32}) = 0").groupBy(F.expr(f"h & {(1 << 48) - 1}").alias("h")).count() for d in (held, train)]
    assert often[0].join(often[1].toDF("h", "n"), "h").agg(F.sum(F.col("count") * F.col("n")).alias("n")).first().n < 550_000


def test_the_cheapest_disjoint_segments_are_chosen():
    def least(cost, size, count):
        sums = [[0.0] + [np.inf] * count for _ in range(len(cost) + size)]
        for p in range(size, len(sums)):
            for j in range(1, count + 1):
                sums[p][j] = min(sums[p - 1][j], sums[p - size][j - 1] + cost[p - size])
        return sums[-1][count]

    rng = np.random.default_rng(1)
    lengths = np.array([0, 63, 70, 5, 100, 127, 200, 255, 256, 300, 700, 3000])
    text = np.concatenate([np.full(n - 6 if n >= 63 else 0, t) for t, n in enumerate(lengths)])
    cost, edits = rng.integers(0, 50, len(text)).astype(float), -(-lengths // 9) - 1
    count = edits + np.minimum(lengths // 7 - edits, overlap.REPEAT)
    rows = overlap.chosen(cost, text, lengths, 7, count)
    for t in np.unique(text):
        own = rows[text[rows] == t]
        assert len(own) == count[t] and (np.diff(own) >= 7).all()
        if lengths[t] < 2 * overlap.BLOCK:
            assert cost[own].sum() == least(cost[text == t], 7, count[t])


def test_grams_are_ordered_by_digits():
    """The order by digits is that of a full sort, for few and for many texts; a text keeps each hash once."""
    rng = np.random.default_rng(2)
    for many in (1, 200, 70_000):
        text, keys = rng.integers(0, many, 5000), rng.integers(0, 200, 5000).astype(np.uint8)
        assert (overlap.by_text(text, keys, stable=True) == np.lexsort((keys, text))).all()
    assert len(overlap.by_text(np.zeros(0, np.int64), np.zeros(0, np.uint64))) == 0
    cps, starts = folding.fold(["", "abc", "abcabcabcabcabcabcabcabc", None, "the old market of the people", ""], marks=False)
    values, text = overlap.winnow(cps, starts)
    assert set(text.tolist()) == {2, 4} and len(set(zip(text.tolist(), values.tolist(), strict=True))) == len(values)
    assert (np.lexsort((values, text)) == np.arange(len(values))).all() and (text == 2).sum() <= 3


def test_what_is_known_is_sent_compressed():
    known = overlap.Known(np.arange(256, dtype=np.uint8), np.zeros(1 << 20, np.uint8))
    sent = pickle.dumps(known)
    got = pickle.loads(sent)
    assert len(sent) < 5000 and (got.often == known.often).all() and (got.evaluation == known.evaluation).all() and got.training is None


def test_letters_that_follow_may_have_one_edit(spark):
    """No pair with one edit at most is lost, and few others are kept."""
    rng, rows = random.Random(1), []
    for _ in range(3000):
        size, letters = rng.choice([5, 6, 7]), rng.choice(["ab", "abcdefgh"])
        t = "".join(rng.choice(letters) for _ in range(size))
        e = list(t + "".join(rng.choice(letters) for _ in range(3)))
        for _ in range(rng.randrange(4)):
            k, kind = rng.randrange(len(e)), rng.randrange(3)
            e[k : k + 1] = [] if kind == 0 else [rng.choice(letters)] if kind == 1 else [rng.choice(letters), e[k]]
        e = "".join(e)[: rng.choice([5, 8])]
        of = lambda x: int(overlap.following(np.array([ord(c) for c in x], np.uint32), np.array([len(x)]), np.array([0]))[0])
        rows.append((of(e), of(t) | ((1 << 4 * size) - 1) << 32, any(overlap.edit_distance(t, e[:n]) <= 1 for n in (size - 1, size, size + 1))))
    got = spark.createDataFrame(rows, "e bigint, t bigint, near boolean").selectExpr("near", f"{overlap.goes_on('e', 't')} as kept", f"{overlap.goes_on('e', '0L')} as free").collect()
    assert all(r.kept for r in got if r.near) and all(r.free for r in got)
    assert sum(r.kept for r in got if not r.near) < 0.03 * sum(not r.near for r in got)


def test_tables_are_joined_by_a_tree(spark):
    """Sums, and behind them bits, over several levels of groups."""

    def count(batches):
        table = np.zeros(128, np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy()
            table[:64] += np.bincount(values % 64, minlength=64)
            some = values[values < 700]
            np.bitwise_or.at(table, 64 + some % 64, 1 << (some % 7))
        return table

    got = table_sums(spark.range(1000).repartition(9), count, 128, 32, fan=2, summed=64)
    want = count(spark.range(1000).toArrow().to_batches())
    assert got.tolist() == want.tolist() and got[:64].sum() == 1000
    assert not table_sums(spark.range(0), count, 128, 32).any()


def test_edited_texts_are_found_though_their_sentences_moved(spark):
    """Edits of 1 to 3 % spread over six sentences in another order (the README has the recall beyond)."""
    rng, rows = random.Random(2), []
    words = ["".join(rng.choice("aeioulmnprstbkd") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for k in range(90):
        parts = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(6)]
        moved = rng.sample([edited(rng, p, round((1 + k % 3) / 100 * len(p.replace(" ", "")))) for p in parts], 6)
        rows += [(10 * k, "train", ". ".join(parts) + "."), (10 * k + 1, "test", ". ".join(moved) + ".")]
    got = {(r.eval_id, r.train_id) for r in overlap.cross_split_overlaps(spark.createDataFrame(rows, "rec_id bigint, split string, text string")).collect()}
    want = {(10 * k + 1, 10 * k) for k in range(90) if overlap.difference(rows[2 * k][2], rows[2 * k + 1][2]) < overlap.DIFFER}
    assert len(want) > 80 and got <= want and len(got) >= 0.95 * len(want)


# --- 6 ----------------------------------------------------------------------------------------------------------------

PAGES = [
    ("wiki", "{{Infobox x\n* no\n}}\n== H ''i''<ref>n</ref> ==\n* a [[b|c]]\n** [http://x.y d] &amp; e\n#<nowiki>[f]</nowiki>\n<pre>\n# g\n</pre>\n<math> x^2 </math>\n{| \n* h\n|}\n[[Category:k]]\n{{stub|l", [("heading", 1, "H i"), ("list_item", 1, "a c"), ("list_item", 2, "d & e"), ("list_item", 3, "[f]"), ("code", 1, "# g"), ("formula", 1, "x^2")]),
    ("wiki", "#REDIRECT [[x]]", []), ("wiki", "#ប្តូរទីតាំង [[ផ្លូវ|x]]", []), ("wiki", "#Boat [[x]]\n#Lamp", [("list_item", 1, "Boat x"), ("list_item", 2, "Lamp")]),
    ("html", "<div><H2 class='t'><b>A</b> b &lt; c<!-- <b> --></H2>\n<script>'<li>no</li>'</script><ul>\n<li>one\n<li value=\"3\"><i>two</i></li></ul><PRE>if a &lt; b\n</PRE>\\( x \\) $$y$$ $5 , $7</div>", [("heading", 1, "A b < c"), ("list_item", 1, "one"), ("list_item", 2, "two"), ("code", 1, "if a < b"), ("formula", 1, "x"), ("formula", 2, "y")]),
    ("markdown", "## A `b` **c** ##\n\nTitle __d__\n====\n\n* [e](http://x)\n  * ~~f~~\n1. g_h_i\n\n```py\n# no\n$x$\n```\n\nprice $5 , $7 and $k \\le 2$\n\n$$\na+b\n$$\n", [("heading", 1, "A b c"), ("heading", 2, "Title d"), ("list_item", 1, "e"), ("list_item", 2, "f"), ("list_item", 3, "g_h_i"), ("code", 1, "# no\n$x$"), ("formula", 1, "k \\le 2"), ("formula", 2, "a+b")]),
    ("latex", "% \\section{no}\n\\begin{document}\n\\subsection*{A \\textbf{b}\\cite{z}}\n\\begin{itemize}\n  \\item {\\it c} \\& d\n  \\item \\href{http://x}{e}\n\\end{itemize}\n\\begin{verbatim}\n\\item no\n\\end{verbatim}\n\\begin{equation}\nx_1\n\\end{equation}\n$y$\n\\end{document}", [("heading", 1, "A b"), ("list_item", 1, "c & d"), ("list_item", 2, "e"), ("code", 1, "\\item no"), ("formula", 1, "x_1"), ("formula", 2, "y")]),
    ("none", "x_1_y costs $5 , $7 and 3 * 4 * 5 [1]", []), ("none", "", []), ("none", None, []),
]


@pytest.fixture(scope="module")
def trees(spark, smallest):
    return markup.fit_tree_model(spark.read.parquet(f"{smallest}/wiki_page.parquet").unionByName(spark.createDataFrame([(p[1],) for p in PAGES], "text string"), allowMissingColumns=True))


@pytest.mark.parametrize(("kind", "text", "want"), PAGES)
def test_elements(trees, kind, text, want):
    got = markup.elements([text], [None], trees)[0]
    order = ["heading", "list_item", "code", "formula"]
    assert sorted(got, key=lambda r: (order.index(r[0]), r[1])) == want
    assert not text or markup.markup_of(text) == kind


def test_marginals_equal_enumeration(trees):
    nodes = markup.parse(PAGES[0][1])[:9]
    kind, parent, depth, cell = (np.array(x) for x in zip(*[(markup.KINDS.index(n.kind), n.parent, n.depth, n.cell) for n in nodes], strict=True))
    total, on = 0.0, np.zeros(len(nodes))
    for bits in range(1 << len(nodes)):
        state = [(bits >> i) & 1 for i in range(len(nodes))]
        weight = np.exp(sum(trees.unary[k, s] + trees.cells[k, c, s] for k, c, s in zip(kind, cell, state, strict=True)) + sum(trees.pair[kind[parent[i]], state[parent[i]], kind[i], state[i]] for i in range(1, len(nodes))))
        total, on = total + weight, on + weight * np.array(state)
    assert np.allclose(trees.marginals(kind, parent, depth, cell), on / total)


def test_marginals_decide_where_no_mark_does(trees):
    """Behind a template that nothing closes, what stands among its fields is hidden and the rest isn't. The tree is the
    same: labels by kinds and parents would treat both alike."""
    body = "{{{{Infobox lamp\n| name = a\n| size = b\n* inside\n\n== H ==\n\nText.\n* {0}\n* two"
    got = markup.elements([body.format("one")], [None], trees)[0]
    assert got == [("heading", 1, "H"), ("list_item", 1, "one"), ("list_item", 2, "two")]
    behind = "People of the village kept {{convert|5|km of it.\n* the first house [[by the river]] and the well\n* the second house and the field\n\n== H =="
    assert [r[0] for r in markup.elements([behind], [None], trees)[0]] == ["list_item", "list_item", "heading"]
    nodes = markup.parse(behind)
    assert markup.label(nodes)[[i for i, n in enumerate(nodes) if n.kind == "list_item"]].tolist() == [0, 0]  # by the rule they were hidden


@pytest.mark.parametrize("piece", ["<ref>a ", "{{x\n* a\n", "<pre>", "\\section{a ", "\\( ", "$$ ", "<li>a", "[[a ", "```\n", "\\begin{verbatim}", "* [[a|b]] {{c}}\n", "<!-- ", "== a ==\n"])
def test_broken_and_endless_pages_take_linear_time(piece):
    assert _growth(lambda n: markup.parse(piece * n)) < 8


def _growth(run, size=4_000):
    """How many times longer four times as much takes (processor time, the least of some runs)."""

    def took(n):
        best = float("inf")
        for _ in range(3):
            begin = time.process_time()
            run(n)
            best = min(best, time.process_time() - begin)
        return best + 0.02

    return took(4 * size) / took(size)


def test_all_signs_of_a_page_count():
    stray = "\n".join(f"<br> <div> <b>b</b> {{{{x{i}}}}} ''y''" for i in range(5))
    assert markup.markup_of("\\section{a}\n\\item b\n" * 100 + stray) == "latex"
    assert markup.markup_of("## A b\n\n[c](http://d) and **e**\n\n- f\n\n" * 100 + stray) == "markdown"


def test_long_formulas_code_and_headings_are_whole(trees):
    long = "x_1 + " * 1500 + "y"
    for kind, text in (("markdown", f"## A\n\n* a\n\n$$\n{long}\n$$\n\nprose\n\n$$z$$\n"), ("latex", f"\\section{{A}}\n$$\n{long}\n$$\nprose\n$$z$$\n\\item b\n"), ("html", f"<div><h2>A</h2><p>$$ {long} $$ prose $$z$$</p></div>")):
        assert markup.markup_of(text) == kind
        assert [r[2] for r in markup.elements([text], [None], trees)[0] if r[0] == "formula"] == [long, "z"], kind
    code = "<div>{{a}}<br></div><p>\n" * 400
    assert markup.markup_of(f"## A\n\n```html\n{code}```\n\n* a\n") == "markdown"
    assert markup.markup_of(f"== A ==\n<syntaxhighlight lang=html>\n{code}</syntaxhighlight>\n[[b]]\n") == "wiki"
    head = "very long heading " * 200
    assert markup.elements([f"\\section{{{head}}}\n\\begin{{itemize}}\\item a\\end{{itemize}}"], [None], trees)[0][0] == ("heading", 1, head.strip())


@pytest.mark.parametrize("piece", ["\\section{", "$$", "$$a$", "\\begin{align} ", "<math>", "~~~\n", "{", "\\section{a} {"])
def test_marks_that_nothing_closes_take_linear_time(piece):
    assert _growth(lambda n: (markup.parse(piece * n), markup.parse("\\section{a}\\item " + piece * n))) < 8


def test_titles_and_clean_text(trees):
    assert markup.clean_title("'''A''' (B)") == "A (B)" and markup.clean_title("A&nbsp;B") == "A B" and markup.clean_title("\\emph{A}") == "A" and markup.clean_title("**A**") == "A" and markup.clean_title("<i>A</i>") == "A"
    assert markup.clean_title("Plain — title [1] x_1_y") is None
    clean = markup.clean_text(PAGES[0][1], trees)
    assert "# H i" in clean and "- d & e" in clean and "Infobox" not in clean and markup.clean_text(None, trees) is None


# --- 7 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return encode.encoder(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")


def test_tree_reduction_equals_one_pass(coder, spark, smallest):
    whole = "\n\n".join(t for t in texts(spark, smallest, "documents") if t)[:20_000]
    for text in (whole, " " * 3000, "a" * 3000, "  \n" * 500 + "x", "don't 'll <|endoftext|> " * 60):
        for leaf in (3, 50, 700):
            assert coder.reduce(text, leaf).ids == coder.words.encode_ordinary(text)
    assert coder.decode(coder.reduce(whole, 100).ids) == whole


def test_ids_equal_the_other_library(spark, smallest):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, smallest).collect()}
    assert got == {k: other.encode(t, add_special_tokens=False).ids if t else [] for k, t in rows.items()}


# --- 8 ----------------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{smallest}/benchmark_case.parquet").select("item_id", "input").collect()
    flat = lambda t: "".join(map(chr, folding._fold_one(t or "")))
    runs = {}
    for r in items:
        f = flat(r.input)
        for k in range(len(f) - 59):
            runs.setdefault(f[k : k + 60], set()).add(r.item_id)
    want = set()
    for r in docs:
        f = flat(r.text)
        want |= {(r.doc_id, i) for k in range(len(f) - 59) for i in runs.get(f[k : k + 60], ())}
    assert {tuple(r) for r in queries.p8_found(spark, smallest).collect()} == want


def test_leaks_in_several_passes_and_parts(spark):
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcdefghij klmnop, ") for _ in range(size))) for i, size in enumerate((200, 300, 5000, 150))]
    docs = [(10 * i + k, f"before {t[a : a + 90]} after") for i, t in items for k, a in enumerate((0, len(t) // 2, len(t) - 95))] + [(99, "nothing of it")]
    found = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, input string"), chars=700)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(d, d // 10) for d, _ in docs[:-1]]


def test_leaks_at_every_length():
    rng = np.random.default_rng(1)
    item = "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 200))
    search = leaks.Patterns([7], [item])
    for start in (0, 1, 29, 30, 31, 100, 139):
        for length in (59, 60, 61):
            doc, item_at = search.search(*folding.fold(["x" * 5 + item[start : start + length] + "yz", "none", None, ""]))
            assert (len(doc) == 1) == (min(length, 200 - start) >= 60)


def test_folding_equals_one_by_one(spark, smallest):
    rows = texts(spark, smallest, "documents") + texts(spark, smallest, "corpus_document") + ["", None, "Straße ﬁ ໜາ ຫນາ ន្ដ", "Ⅷ é"]
    for marks in (True, False):
        cps, starts = folding.fold(rows, marks)
        for i, t in enumerate(rows):
            want = folding._fold_one(t or "")
            want = want if marks else want[~folding._is_mark()[want]]
            assert cps[starts[i] : starts[i + 1]].tolist() == want.tolist()


# --- 9 ----------------------------------------------------------------------------------------------------------------

PROSE = "The lamp of Bel was old and the people of Kar sold it in 1903. Every house by the river needs a blue door; Roubax learned this at Tar."
SPAM = ["cheap lamp buy door " * 15, "\n".join(f"www.bel{i}.example/p/{i}" for i in range(12)), " ".join(f"#tag{i % 4}" for i in range(40)), " | ".join(["buy lamp", "cheap door"] * 15), "brand: lamp size: door color: house tag: road " * 5, "ទិញផ្ទះលក់គោ" * 20]


def test_prose_shares():
    x, judged = spam._matrix([PROSE, PROSE + "\n\n- http://a.example/1\n- http://b.example/2", *SPAM, "short", None, ""])
    assert judged.tolist() == [True] * 8 + [False] * 3
    assert (x[:2, 0] > 0.5).all() and (x[2:8, 0] <= 0.5).all()


def test_trees_learn_a_boundary():
    rng = np.random.default_rng(0)
    x = rng.random((600, 13)).astype(np.float32)
    y = ((x[:, 0] < 0.5) & (x[:, 3] > 0.3)).astype(int)
    trees = spam.Trees.fit(x[:400], y[:400], columns=8)
    assert ((trees.score(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def test_spam_is_found_whatever_its_host(spark):
    rows = [(i, PROSE + f" It rained {i} days.", "big") for i in range(60)] + [(100 + i, s, None if i % 2 else "big") for i, s in enumerate(SPAM)] + [(200, None, "x"), (201, "  ", "x")]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id for r in spam.spam_pages(pages, spam.fit_trees(pages)).collect()}
    assert got == {100 + i for i in range(len(SPAM))}


def test_the_overall_rate_is_that_of_all_rows(spark):
    """Half spam of one text: rates are held against the rows, not against the sample the trees are fitted on."""
    rows = [(i, PROSE + f" It rained {i} days.", "a") for i in range(20)] + [(100 + i, SPAM[0], "b") for i in range(20)]
    pages = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    trees = spam.Trees([np.array([[0, 0.5, 1, 2, 0], [-1, 0, 0, 0, 0.19], [-1, 0, 0, 0, 0.1]])])
    scores = {}
    for trees.overall in (0.05, 0.9):
        scores[trees.overall] = {r.doc_id: r.score for r in spam.spam_pages(pages, trees).collect()}
    assert scores[0.05] == scores[0.9]


# --- odd tables ---------------------------------------------------------------------------------------------------------

LONG = "ឡើងវិញ text បាន។ " * 20_000
ODD = [("a", None), ("b", ""), ("c", " \n\t "), ("d", "..."), ("e", "🙂 \U0001F468‍\U0001F469"), ("f", LONG), ("g", "ក"), ("g", "ក"), (None, "The people of the village sold it. Yes.")]


def odd(spark, rows=ODD):
    """Nulls, blanks, odd and long texts, repeated rows and keys, and columns with clashing names."""
    df = spark.createDataFrame(rows, "id string, text string")
    return df.select("id", "text", F.expr(TIMES).alias("loaded_at"), F.lit(None).cast("string").alias("language"), F.lit("x").alias("_text"), F.lit(1).alias("form"), F.lit("y").alias("cls"), F.lit("z").alias("hash"))


def run_all(spark, df, model, trees, ends):
    own = df.withColumn("title", F.col("text")).withColumn("split", F.lit("test")).withColumn("instruction", F.col("text")).withColumn("input", F.col("text")).withColumn("output", F.col("text")).withColumn("source", F.lit(None).cast("string"))
    items = df.select(F.lit(1).alias("item_id"), F.col("text").alias("input"))
    return {
        "languages": langid.with_languages(own, model).count(),
        "labels": langid.mislabelled_segments(own, model).count(),
        "forms": confusables.with_consistent_form(own, "id").count(),
        "pairs": confusables.look_alike_pairs(own, "id").count(),
        "sentences": sentences.with_sentences(own).count(),
        "defects": pairs.with_defects(own, model, ends, "id").count(),
        "overlaps": overlap.cross_split_overlaps(own, "id").count(),
        "report": overlap.overlap_report(own, "id").count(),
        "elements": markup.with_elements(own, trees, "id").count(),
        "clean": markup.with_clean_text(own, trees, "id").count(),
        "ids": encode.with_token_ids(own, "id").count(),
        "leaks": leaks.leaked_items(own, items, "id").count(),
        "spam": spam.spam_pages(own, spam.fit_trees(own), "id").count(),
    }


def test_odd_and_empty_tables(spark, model, trees):
    ends = pairs.EndModel(np.zeros(1 << pairs.END_BITS), np.zeros(1 << pairs.END_BITS))
    got = run_all(spark, odd(spark), model, trees, ends)
    assert got["languages"] == got["forms"] == got["clean"] == got["ids"] == len(ODD) and got["pairs"] == 0 and got["overlaps"] == 0
    assert got["leaks"] >= 1 and got["sentences"] > 3
    assert set(run_all(spark, odd(spark).limit(0), model, trees, ends).values()) == {0}


def test_ends_are_counted_over_all_texts(spark):
    rows = [(f"A text of more than forty characters that ends like this number{i % 3}.",) for i in range(40)] + [(None,), ("",)]
    fitted = pairs.fit_ends(spark.createDataFrame(rows, "text string").repartition(3))
    assert fitted.likelihood("whatever.")[0] > 0.9 and fitted.likelihood("whateve")[0] < 0.05


def test_latest_delivery_wins(spark, model):
    rows = [("a", "The people of the village sold the old lamp and the house.", "2024-01-01 00:00:00", "fr"), ("a", "The people of the village sold the old lamp and the house.", "2024-02-01 00:00:00", "en")]
    df = spark.createDataFrame(rows, "id string, text string, t string, language string").select("id", "text", "language", F.to_timestamp("t").alias("loaded_at"))
    assert langid.mislabelled_segments(df, model).count() == 0
    assert langid.mislabelled_segments(df.where("language = 'fr'"), model).collect()[0].lang == "en"
