import numpy as np
import pytest
from pyspark.sql import functions as F

from borei.functions import unicode as U
from borei.functions.wikitext import clean_wikitext
from borei.operators import dedup, split
from borei.plans.pipeline import run_pipeline, to_sentences

BODY = "កម្ពុជាជាប្រទេសមួយនៅអាស៊ីអាគ្នេយ៍។ ភ្នំពេញជារាជធានីនៃព្រះរាជាណាចក្រកម្ពុជា ដែលមានប្រជាជនរស់នៅច្រើនណាស់។"
OTHER = "ទន្លេសាបជាបឹងទឹកសាបធំជាងគេនៅអាស៊ីអាគ្នេយ៍ ហើយផ្ដល់ត្រីដល់អ្នកស្រុកជាច្រើនឆ្នាំមកហើយ។"


def brute_keep_first(rows):
    """The rule itself, one document after the other."""
    seen, buckets, out = set(), {}, {}
    for i, sig, h in rows:
        sig = np.array(sig)
        cells = [(b, sig[b * 8 : b * 8 + 8].tobytes()) for b in range(8)]
        if h in seen:
            out[i] = "exact"
        elif any((k == sig).mean() >= 0.8 for c in cells for k in buckets.get(c, ())):
            out[i] = "near"
        else:
            seen.add(h)
            out[i] = None
            for c in cells:
                buckets.setdefault(c, []).append(sig)
    return out


def test_keep_first_equals_the_sequential_rule(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/corpus_document.parquet").select("id", "text").distinct()
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("id", text.alias("t"), U.content_hash(text).alias("h"))
    rows = dedup.with_signature(hashed, U.shingles("t")).select("id", F.col("sig").alias("s"), "h").orderBy("id").collect()
    got = dedup.deduplicate(docs, "text", "id").select("id", "duplicate").collect()
    assert len(got) == len(rows)
    want = brute_keep_first([tuple(r) for r in rows])
    assert {r.id: r.duplicate for r in got} == want


def test_signatures_equal_one_by_one(spark):
    rows = spark.createDataFrame([(1, ["ab", "ក"]), (2, []), (3, None), (4, ["x"] * 3), (5, [str(i) for i in range(700)])], "id int, s array<string>")
    a, b = dedup.coefficients()
    got = {r.id: r.sig for r in dedup.with_signature(rows, F.col("s")).collect()}
    assert got == {r.id: None if r.s is None else dedup.sign(r.s, a, b).tolist() for r in rows.collect()}
    big = np.random.default_rng(0).integers(0, 1 << 32, 50_000)
    counts = np.array([0, 30_000, 0, 1, 19_999, 0])
    out = dedup.sign_batch(big, counts, a, b)
    x = big[:30_000].astype(np.uint64)
    assert out[1].tolist() == ((x[:, None] * a + b) % np.uint64(dedup.PRIME)).min(axis=0).tolist() and (out[[0, 2, 5]] == dedup.NONE).all()


def test_chains_keep_both_ends(spark):
    """a~b, b~c, a!~c: b goes, a and c stay."""
    def sig(values):
        return [int(v) for v in values]

    a = np.arange(64)
    b, c = a.copy(), a.copy()
    b[54:] += 1000
    c[44:] += 1000
    heads = spark.createDataFrame([(1, sig(a)), (2, sig(b)), (3, sig(c))], "ord bigint, sig array<bigint>")
    assert {r.ord: r.kept for r in dedup.near_verdicts(heads).collect()} == {1: True, 2: False, 3: True}


def test_a_hot_bucket_costs_no_pairs(spark):
    """Two hundred copies of nearly one text in every bucket: one is kept, and the first round decides."""
    texts = [(f"d{i:04d}", BODY + f" {i}។") for i in range(200)]
    out = dedup.deduplicate(spark.createDataFrame(texts, "id string, text string"), "text", "id")
    counts = {r.duplicate: r.n for r in out.groupBy("duplicate").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts.get(None) == 1 and counts.get("near", 0) == 199


def test_pipeline_counts_every_document_once(spark):
    rows = [("a", BODY, "CC-BY-4.0"), ("b", BODY, "CC-BY-4.0"), ("c", OTHER, " "), ("d", "This is an English document about nothing at all.", "CC0"), ("e", "ក្រុង", "CC0"), ("f", OTHER, None), ("g", None, "CC0")]
    result = run_pipeline(spark.createDataFrame(rows, "id string, text string, license string"))
    row = result.stats.first().asDict()
    assert row["input"] == 7 == sum(v for k, v in row.items() if k != "input")
    assert (row["missing_license"], row["exact_duplicate"], row["wrong_language"], row["too_short"], row["output"]) == (2, 1, 2, 1, 1)
    assert "missing_license" in result.report()
    assert to_sentences(result.documents, "text", "id").count() == 2


@pytest.mark.parametrize(("n", "want"), [(100, (80, 10, 10)), (0, (0, 0, 0)), (5, (3, 1, 1)), (2, (2, 0, 0))])
def test_split_sizes_are_exact(spark, n, want):
    out = split.split_documents(spark.range(n).select(F.col("id").cast("string").alias("id")), "id", 0.1, 0.1)
    got = {r.split: r.documents for r in split.split_sizes(out).collect()}
    assert (got.get("train", 0), got.get("validation", 0), got.get("test", 0)) == want
    with pytest.raises(ValueError, match="room"):
        split.sizes(10, 0.5, 0.5)


def test_split_needs_several_levels(spark):
    out = split.split_documents(spark.range(20_000).select(F.col("id").cast("string").alias("id")), "id", 0.3, 0.2)
    assert {r.split: r.documents for r in split.split_sizes(out).collect()} == {"train": 10_000, "validation": 6_000, "test": 4_000}


PAGES = [
    ("A{{outer|x{{inner|y}}z}}B", "AB"), ("text {{unclosed", "text"), ("[http://example.com Example] tail", "Example tail"), ("[[a|b]] [[c]]", "b c"), ("[[File:x.png|y]]z", "z"), ("== H ==\n* item", "H\nitem"), ("'''b''' <b>t</b>__NOTOC__", "b  t"), ("a [[open", "a [[open"), ("x<!-- c -->y<ref>n</ref>", "x y"), ("{| t |}u", "u"),
    ("[[File:x|thumb [[a]] b]] c", "b]] c"), ("}} stray {{{a}}}b", "stray }b"), ("[[a|b|c]][[រូបភាព:x]]", "c"), ("\n\n\n\nx\n\n\n\ny", "x\n\ny"), ("", ""), (None, None),
]


def test_wikitext(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PAGES)], "i int, t string").orderBy("i").select(clean_wikitext("t").alias("c")).collect()
    assert [r.c for r in rows] == [w for _, w in PAGES]
