import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from borei.functions import unicode as U
from borei.operators import embeddings, evaluate, lm
from borei.operators import tokenizers as T
from borei.plans import training


def test_edit_distances(spark):
    assert evaluate.edit_distance(list("kitten"), list("sitting")) == 3 and evaluate.edit_distance([], list("ab")) == 2
    rows = spark.createDataFrame([(0, "កម្ពុជា", "កជា"), (1, "", ""), (2, "", "ក"), (3, "ក", "កកកកក"), (4, None, "ក")], "i int, r string, h string")
    got = rows.select("i", evaluate.character_error_rate("r", "h").alias("cer"), evaluate.grapheme_error_rate("r", "h").alias("ger")).orderBy("i").collect()
    assert [r.cer for r in got] == [pytest.approx(4 / 7), 0.0, 1.0, 4.0, None] and [r.ger for r in got] == [pytest.approx(1 / 3), 0.0, 1.0, 4.0, None]


def test_validity(spark):
    assert evaluate.validity_rate(spark.createDataFrame([("ក",), ("ា",)], "text string")).first()[0] == 0.5
    assert evaluate.validity_rate(spark.createDataFrame([], "text string")).first()[0] == 0.0
    assert {r.code: r.n for r in evaluate.error_counts(spark.createDataFrame([("ក្",), ("ា្",)], "text string")).collect()} == {"coeng-no-consonant": 2, "orphan-combining-mark": 1}


def test_benchmark(spark):
    assert all(r.exact for r in evaluate.run_benchmark(evaluate.structural_cases(spark), evaluate.structural_prediction()).collect())
    cases = spark.createDataFrame([("a", "1", "1", ""), ("a", "2", "2", ""), ("b", "3", "wrong", "")], "category string, input string, expected string, note string")
    results = evaluate.run_benchmark(cases, lambda c: c)
    scores = {r.category: r for r in evaluate.category_scores(results).collect()}
    assert scores["a"].exact_match == 1.0 and scores["b"].exact_match == 0.0 and scores[None].cases == 3
    assert "OVERALL" in evaluate.format_benchmark(results)


def test_grounding(spark):
    index = evaluate.Grounding(spark.createDataFrame([("កខគ",), ("គឃ",)], "text string"), orders=(2, 3))
    assert {r.n: r.grams for r in index.sizes().collect()} == {2: 3, 3: 1}
    got = {(r.id, r.n): (r.total, r.attested) for r in index.score(spark.createDataFrame([(1, "កខខ"), (2, ""), (3, None)], "id int, text string"), "id").collect()}
    assert got == {(1, 2): (2, 1), (1, 3): (1, 0), (2, 2): (0, 0), (2, 3): (0, 0), (3, 2): (0, 0), (3, 3): (0, 0)}


def test_output_checks(spark):
    rows = {r.id: r for r in evaluate.analyze_outputs(spark.createDataFrame([(1, "ក" * 20), (2, "កម្ពុជា"), (3, None)], "id int, text string"), "id").collect()}
    assert [c.status for c in rows[1].checks][:3] == ["PASS", "PASS", "FAIL"] and rows[1].checks[2].score == 20.0 and not rows[1].passed
    assert "Khmer script" in evaluate.format_report(rows[2]) and lm.relative_error(np.array([1.0]), np.array([2.0])) == 0.5
    assert rows[2].passed and rows[2].coverage == "3/7 checks implemented"


def test_script_share_is_the_script_ratio(spark):
    """Digits and punctuation have no script and don't count against a text."""
    rows = spark.createDataFrame([("កម្ពុជា, 2026! (…)",), ("កabc",), ("12",), (None,)], "t string").select(evaluate.khmer_share("t").alias("s"), U.script_ratio("t").alias("r")).collect()
    assert rows[0].s == 1.0 and [x.s for x in rows] == [x.r or 0.0 for x in rows]


def test_vectors_stay_finite_on_counts_of_a_corpus(spark):
    corpus = spark.createDataFrame([(i, "កខគឃង " * 200) for i in range(20)], "id int, text string")
    model = embeddings.Word2Vec(T.GraphemeTokenizer(), dim=8)
    losses = model.train(corpus, "id", epochs=60)
    assert np.isfinite(model.vectors).all() and abs(model.vectors).max() < 50 and losses[-1] < losses[0]


def test_translations(spark):
    cache = spark.createDataFrame([("km", "en", "ក", "ka", 0.4), ("en", "km", "ka", "ក", 0.9), ("km", "fr", "ក", "k", 1.0)], "source string, target string, text string, translated string, match double")
    rows = spark.createDataFrame([(1, " ក "), (2, "  "), (3, "ខ")], "id int, text string")
    got = {r.id: (r.translated, r.low_confidence) for r in evaluate.translate(rows, cache).collect()}
    assert got == {1: ("ka", True), 2: (None, None), 3: (None, None)}
    assert {r.id: r.back for r in evaluate.round_trip(rows, cache).collect()}[1] == "ក"


def test_cosine_search_equals_brute_force(spark, smallest):
    vectors = spark.read.parquet(f"{smallest}/embeddings.parquet").select("vec_id", "embedding")
    got = {(r.query, r.neighbour) for r in embeddings.cosine_top(vectors.where("vec_id % 50 = 0"), vectors, block=3).collect()}
    rows = vectors.collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for i, r in enumerate(rows):
        if r.vec_id % 50 == 0:
            s = m @ m[i]
            s[i] = -2
            want |= {(r.vec_id, rows[j].vec_id) for j in np.argsort(-s)[:5]}
    assert got == want


def test_skipgrams_and_vectors(spark):
    corpus = spark.createDataFrame([(1, "កខគ")], "id int, text string")
    pairs = sorted((r.center, r.context) for r in embeddings.training_pairs(corpus, T.GraphemeTokenizer(), "id", window=1).collect())
    assert pairs == [("ក", "ខ"), ("ខ", "ក"), ("ខ", "គ"), ("គ", "ខ")]
    model = embeddings.Word2Vec(T.GraphemeTokenizer(), dim=8, min_count=3)
    losses = model.train(spark.createDataFrame([(1, "កកក ខ")], "id int, text string"), "id", epochs=3)
    assert "ក" in model.vocab and "ខ" not in model.vocab and len(losses) == 3 and not model.noise[:4].any()
    assert model.get_vector("ខ") is None and model.similarity("ក", "zzz") is None
    assert embeddings.Word2Vec(T.GraphemeTokenizer()).train(spark.createDataFrame([], "id int, text string"), "id") == []


@pytest.mark.parametrize("tied", [True, False])
def test_gradients(tied):
    model = lm.GPT(lm.GPTConfig(7, dim=8, num_layers=2, num_heads=2, max_seq_len=5, tie_embeddings=tied), seed=3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 7, (2, 4)), rng.integers(0, 7, (2, 4))
    mask = np.array([[1, 0, 1, 1], [0, 1, 1, 1]])
    grads = model.loss(x, y, mask)[1]
    for name in model.params:
        numeric = lm.numerical_gradient(lambda: lm.cross_entropy(model.forward(x)[0], y, mask)[0], model.params[name])
        assert lm.gradients_match(grads[name], numeric, 1e-4, 1e-8), name


def test_schedule_clip_and_loss():
    assert lm.cosine_lr(0, 100, 1.0, 10) == pytest.approx(0.1) and lm.cosine_lr(9, 100, 1.0, 10) == 1.0 and lm.cosine_lr(100, 100, 1.0, 10) == pytest.approx(0.1)
    grads = {"a": np.array([3.0, 4.0])}
    assert lm.clip_grad_norm(grads, 1.0) == 5.0 and np.linalg.norm(grads["a"]) == pytest.approx(1.0)
    assert lm.cross_entropy(np.zeros((1, 1, 8)), np.zeros((1, 1), int))[0] == pytest.approx(math.log(8))
    assert lm.cross_entropy(np.zeros((1, 1, 8)), np.zeros((1, 1), int), np.zeros((1, 1)))[0] == 0.0
    p = {"x": np.array([1.0])}
    lm.SGD(p, 0.1).step({"x": np.array([2.0])})
    assert p["x"][0] == pytest.approx(0.8)
    tied, loose = (lm.GPT(lm.GPTConfig(20, dim=16, tie_embeddings=t)).num_parameters() for t in (True, False))
    assert loose - tied == 320
    with pytest.raises(ValueError, match="multiple"):
        lm.GPTConfig(10, dim=9, num_heads=2)


def test_reports():
    rows = lambda *held: [(1.0, 1.0, 0.1, h) for h in held]
    assert lm.TrainingReport(rows(1.0, math.nan, 0.5, 0.9)).overfitting and not lm.TrainingReport(rows(1.0, 0.7, math.nan, 0.5)).overfitting
    assert math.isnan(lm.TrainingReport().last("loss")) and not lm.TrainingReport().improved


def test_stream_and_windows(spark):
    corpus = spark.createDataFrame([(i, "abc") for i in range(17)], "id bigint, text string")
    tokenizer = T.CharacterTokenizer().train(corpus)
    data = lm.encode_corpus(corpus, tokenizer)
    assert data.tolist() == tokenizer.encode("abc") * 17
    rows = evaluate.windows(lm.token_stream(corpus, tokenizer), 5).collect()
    assert len(rows) == 10 and all(r.targets[:-1] == r.inputs[1:] for r in rows)
    x, y = lm.make_batch(np.arange(50), 4, 6, np.random.default_rng(0))
    assert (y == x + 1).all()
    assert evaluate.perplexity(spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, tokens bigint")).first().mean_loss == 1.25


def test_training_end_to_end(spark, tmp_path):
    corpus = spark.createDataFrame([(f"d{i}", s) for i, s in enumerate(T.SAMPLE * 4)], "id string, text string")
    out = training.train_model(corpus, tmp_path / "m", vocab_size=60, steps=30, seq_len=8, tokenizer=T.GraphemeTokenizer(), dim=16, num_layers=1)
    assert out["report"].improved and out["perplexity"].perplexity > 1
    model, tokenizer = lm.load_checkpoint(out["path"])
    assert np.allclose(model.params["tok"], out["model"].params["tok"]) and tokenizer.vocab.tokens == out["tokenizer"].vocab.tokens
    ids = model.generate(tokenizer.encode("កម្ពុជា"), 5, 0.0)
    assert len(ids) == len(tokenizer.encode("កម្ពុជា")) + 5
    model.generate(tokenizer.encode("ក"), 3, 0.8, top_k=3, top_p=0.9, repetition_penalty=1.2, rng=np.random.default_rng(0))
    tuned = training.tune_sampling(model, tokenizer, corpus, ["ក"], seeds=1, length=5)
    assert tuned.count() == len(training.CANDIDATES)


def test_instructions(spark):
    rows = spark.createDataFrame([(1, "q", "answer", ""), (2, "q", "a" * 99, "x"), (3, None, "a", None)], "example_id bigint, instruction string, output string, input string")
    tokenizer = T.CharacterTokenizer().train(rows.select(F.concat_ws("", lm.format_prompt("instruction", "input"), "output").alias("text")))
    encoded = lm.encode_examples(rows, tokenizer, 60)
    row = encoded.collect()
    assert [r.example_id for r in row] == [1] and sum(row[0].mask) == len("answer") + 1 and row[0].ids[-1] == 3
    batch = lm.padded_batches(encoded).first()
    assert len(batch.inputs) == len(batch.targets) == len(batch["mask"]) == len(row[0].ids) - 1
    model = lm.GPT(lm.GPTConfig(len(tokenizer.vocab), dim=16, max_seq_len=60))
    losses = lm.finetune(model, lm.padded_batches(encoded), steps=8, lr=1e-2)
    assert losses[-1] < losses[0]
    said = rows.where("example_id = 1").select(lm.answers(rows, model, tokenizer, 3).alias("a")).first().a
    assert isinstance(said, str)
