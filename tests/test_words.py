import math
import random
from collections import Counter
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from borei.functions import unicode as U
from borei.operators import grammar, lexicon
from borei.operators import tokenizers as T

WORDS = [("ខ្ញុំ", "pron", 50), ("ចង់", "verb", 20), ("ទៅ", "verb", 40), ("ភ្នំពេញ", "noun", 10), ("ភ្នំ", "noun", 8), ("កម្ពុជា", "noun", 30), ("ជា", "verb", 60), ("ប្រទេស", "noun", 12)]


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(WORDS, "word string, pos string, count bigint")


def test_vocabulary():
    v = T.Vocabulary()
    assert [v.encode_token(s) for s in T.SPECIALS] == [0, 1, 2, 3] and v.decode_id(99) == T.UNK
    v.add("x")
    assert T.Vocabulary.from_dict(v.to_dict()).tokens == v.tokens and "x" in v and len(v) == 5


def test_counting_tokenizers(spark):
    t = T.CharacterTokenizer().train(corpus(spark, "abc"))
    assert t.decode(t.encode("cab")) == "cab"
    rate = corpus(spark, "abcd", "").select(t.unknown_rate(F.col("text")).alias("u"), t.ids(F.col("text")).alias("i")).collect()
    assert rate[0].u == 0.25 and rate[0].i == t.encode("abcd") and rate[1].u == 0.0
    back = corpus(spark, "abc").select(t.text_of(t.ids(F.col("text"))).alias("x")).first().x
    assert back == "abc"
    top = T.CharacterTokenizer().train(corpus(spark, "bbbaac"), vocab_size=6)
    assert top.vocab.tokens[4:] == ["b", "a"]


def test_merges(spark):
    t = T.BPETokenizer().train(corpus(spark, "ababab"), vocab_size=100, min_frequency=1)
    assert t.merges[0] == ("a", "b") and t.pieces_of("ababab") == ["ababab"]
    assert T.restore(T.state_of(t)).pieces_of("abab") == t.pieces_of("abab")


def test_merges_equal_recounting(spark):
    texts = ["កម្ពុជាកម្ពុជា", "កម្ពុ", "ជាកម្ពុជា", "aaab", "aab"]
    t = T.BPETokenizer().train(corpus(spark, *texts), vocab_size=14, min_frequency=2)
    seqs, want = [T.clusters_of(x) for x in texts], []
    while len(want) < len(t.merges):
        counts = {}
        for s in seqs:
            for p in pairwise(s):
                counts[p] = counts.get(p, 0) + 1
        best = max(counts, key=lambda p: (counts[p], p))
        want.append(best)
        seqs = [T.merged(s, best) for s in seqs]
    assert t.merges == want


def test_merges_in_stages(spark, monkeypatch):
    """The same merges when the driver may hold few pairs and symbols, so that it must come back for more."""
    texts = ["កម្ពុជាកម្ពុជា", "កម្ពុ", "ជាកម្ពុជា", "aaab", "aab", "aaaaaaa", "baaaab", "cabcab", "cab", ""]
    whole = T.BPETokenizer().train(corpus(spark, *texts), vocab_size=19)
    stages, learn = [], T.BPETokenizer.learn
    monkeypatch.setattr(T.BPETokenizer, "learn", lambda self, *rest: stages.append(len(self.merges)) or learn(self, *rest))
    monkeypatch.setattr(T, "PAIRS", 3)
    monkeypatch.setattr(T, "SYMBOLS", 8)
    t = T.BPETokenizer().train(corpus(spark, *texts), vocab_size=19)
    assert len(stages) > 2 and t.merges == whole.merges and len(t.merges) == 6 and t.vocab.tokens == whole.vocab.tokens


def test_merges_leave_texts_on_the_executors(spark, monkeypatch):
    """Of 8,000 distinct texts the driver gets symbols, the most frequent pairs and runs of these."""
    rng, got = random.Random(1), []
    letters = [chr(0x4E00 + i) for i in range(80)]
    weights = [1 / (i + 1) for i in range(80)]
    texts = list(dict.fromkeys("".join(rng.choices(letters, weights, k=7)) for _ in range(8200)))[:8000]
    rows = corpus(spark, *texts)
    for name in ("collect", "toLocalIterator"):
        real = getattr(type(rows), name)
        monkeypatch.setattr(type(rows), name, lambda self, *a, real=real, **k: got.extend(out := list(real(self, *a, **k))) or out)
    t = T.BPETokenizer().train(rows, vocab_size=92)
    seqs, want = [list(x) for x in texts], []
    while len(want) < 8:
        counts = Counter(p for s in seqs for p in pairwise(s))
        want.append(max(counts, key=lambda p: (counts[p], p)))
        seqs = [T.merged(s, want[-1]) for s in seqs]
    assert t.merges == want and len(got) < len(texts) / 2


def test_unigram(spark):
    t = T.UnigramTokenizer().train(corpus(spark, *T.SAMPLE), vocab_size=90)
    assert len(t.logprobs) <= 100 and all("".join(t.pieces_of(s)) == s for s in T.SAMPLE)
    units = T.clusters_of("កម្ពុជា")

    def ways(at):
        if at == len(units):
            return [[]]
        return [["".join(units[at:e]), *rest] for e in range(at + 1, min(len(units), at + 4) + 1) for rest in ways(e)]

    scores = [sum(t.score_of(p) for p in w) for w in ways(0)]
    assert t.log_probability("កម្ពុជា") == pytest.approx(max(scores))
    counts, likelihood = t.expected(units)
    assert likelihood == pytest.approx(math.log(sum(math.exp(s) for s in scores)))
    assert sum(len(T.clusters_of(p)) * c for p, c in counts.items()) == pytest.approx(len(units))


def test_comparison(spark):
    rows = {r.name: r for r in T.compare({"character": T.CharacterTokenizer(), "grapheme": T.GraphemeTokenizer()}, corpus(spark, *T.SAMPLE), vocab_size=100).collect()}
    assert rows["character"].compression_ratio == 1.0 and rows["character"].unknown_rate == 0.0
    assert rows["character"].avg_sequence_length == 30.75 and rows["grapheme"].avg_sequence_length == 15.625
    assert (rows["character"].vocab_size, rows["grapheme"].vocab_size) == (51, 79)


def test_unigram_on_the_sample(spark):
    """The published row of the eight sentences: 116 tokens, 4.25 a text, 7.24 characters a token, none unknown."""
    row = T.compare({"unigram": T.UnigramTokenizer()}, corpus(spark, *T.SAMPLE), vocab_size=200).first()
    assert (row.vocab_size, row.avg_sequence_length, round(row.compression_ratio, 2), row.unknown_rate) == (116, 4.25, 7.24, 0.0)


def test_merges_need_room(spark):
    with pytest.warns(UserWarning, match="no room"):
        assert T.BPETokenizer().train(corpus(spark, "abcdef"), vocab_size=6).alphabet_exceeds_vocab


def test_paths_equal_one_text_at_a_time(spark, table):
    """Best paths of a batch against a plain search over all cuts, ties included."""
    words = lexicon.Lexicon(table)
    texts = ["ខ្ញុំចង់ទៅភ្នំពេញ", "", "កម្ពុជាជាប្រទេស X", "ភ្នំភ្នំពេញជា" * 3, "ឡឡ"]

    def plain(units):
        top, cut = [0.0], [0]
        for end in range(1, len(units) + 1):
            ways = [(top[a] + words.logprobs.get("".join(units[a:end]), lexicon.UNKNOWN_LOGPROB if end - a == 1 else -math.inf), -a) for a in range(end)]
            top.append(max(ways)[0])
            cut.append(-max(ways)[1])
        out, end = [], len(units)
        while end:
            out.append("".join(units[cut[end] : end]))
            end = cut[end]
        return out[::-1]

    got = lexicon.Segmenter(words).segmented(texts)
    assert [[w["text"] for w in row] for row in got] == [plain(T.clusters_of(t)) for t in texts]


def test_segmentation(spark, table):
    words = lexicon.Segmenter(lexicon.Lexicon(table))
    assert [w["text"] for w in words.words_of("ខ្ញុំចង់ទៅភ្នំពេញ")] == ["ខ្ញុំ", "ចង់", "ទៅ", "ភ្នំពេញ"]
    row = corpus(spark, "ខ្ញុំចង់ X").select(words.words("text").alias("w")).select(lexicon.coverage(F.col("w")).alias("c"), lexicon.unknown_words(F.col("w")).alias("u")).first()
    assert row.c == 1.0 and row.u == []


def test_spelling(spark, table):
    asked = spark.createDataFrame([("កម្ពុជ",), ("កម្ពុជា",), ("ឡឡឡឡ",), (None,)], "word string")
    got = {r.word: (r.verdict, r.suggestions) for r in lexicon.check_words(asked, table).collect()}
    assert got["កម្ពុជ"][0] == "MISSPELLED" and got["កម្ពុជ"][1][0] == "កម្ពុជា"
    assert got["កម្ពុជា"] == ("CORRECT", []) and got["ឡឡឡឡ"] == ("UNKNOWN", [])
    cut = corpus(spark, "កខគ").select(lexicon.deletions(F.col("text")).alias("d")).first().d
    assert cut == ["ខគ", "កគ", "កខ"]


def test_built_lexicon(spark):
    heads = spark.createDataFrame([(0, "ជា", "verb"), (1, "ជា", "noun"), (2, "abc", "x")], "ord bigint, word string, pos string")
    rows = {r.word: r for r in lexicon.build_lexicon(spark, heads, corpus(spark, "ជាជា កម្ពុជា")).collect()}
    assert rows["ជា"].pos == "verb" and rows["ជា"]["count"] == 3 and "abc" not in rows and rows["១"].pos == "numeral"


@pytest.mark.parametrize(("text", "field", "want"), [("ខ្ញុំបានទៅ។", "tense", "past"), ("គេកំពុងហែល។", "aspect", "continuous"), ("គេទៅហើយ។", "aspect", "perfective"), ("ខ្ញុំមិនទៅទេ។", "is_negated", True), ("តើអ្នកទៅណា?", "is_question", True), ("គេទៅទេ។", "is_question", True)])
def test_grammar(spark, text, field, want):
    row = grammar.analyze_text(corpus(spark, text), "id").first()
    assert row[field] == want


def test_markers(spark):
    """Buried words are none, longer ones come first, one that begins before a longer one stays, ទេ counts at the end only."""
    texts = ["កម្ពុជា", "ហេតុអ្វី", "មិនឹង", "ឥត្រូវា", "ទេគាត់ទៅទេ។ !", "សម្រាប់", "ជាជាជា", "", None]
    got = [r.m and [(m["word"], m["index"]) for m in r.m] for r in corpus(spark, *texts).orderBy("id").select(grammar.analyze("text").alias("m")).collect()]
    assert got == [[], [("ហេតុអ្វី", 0)], [("មិន", 0)], [("ឥត", 0), ("ត្រូវ", 1)], [("គាត់", 2), ("ទេ", 8)], [("សម្រាប់", 0)], [("ជា", 0), ("ជា", 2), ("ជា", 4)], [], None]


def test_ngrams_guard_short_texts(spark):
    assert corpus(spark, "ក", "").select(F.size(U.ngrams(U.graphemes("text"), 3)).alias("n")).collect()[0].n == 0
