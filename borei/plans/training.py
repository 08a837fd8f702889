"""End-to-end training: corpus to model, instructions to tuned model, and the study of decoding settings."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borei.functions import unicode as U
from borei.operators import evaluate, lm
from borei.operators.split import split_documents
from borei.operators.tokenizers import BPETokenizer, Tokenizer


def train_model(corpus: DataFrame, out: str | Path | None = None, key: str = "id", vocab_size: int = 500, steps: int = 100, seq_len: int = 32, tokenizer: Tokenizer | None = None, **config) -> dict:
    """Split, a tokenizer on the training part only, training with validation, perplexity on the test part, checkpoint."""
    parts = split_documents(corpus, key).persist()
    part = lambda name: parts.where(F.col("split") == name)
    tokenizer = (tokenizer or BPETokenizer()).train(part("train"), vocab_size=vocab_size)
    data, held = (lm.encode_corpus(part(n), tokenizer, key) for n in ("train", "validation"))
    model = lm.GPT(lm.GPTConfig(len(tokenizer.vocab), max_seq_len=seq_len, **config))
    report = lm.train(model, data, steps=steps, seq_len=seq_len, validation=held if len(held) > seq_len + 2 else None)
    losses = lm.window_losses(evaluate.windows(lm.token_stream(part("test"), tokenizer, key), seq_len), model)
    result = {"model": model, "tokenizer": tokenizer, "report": report, "perplexity": evaluate.perplexity(losses).first()}
    if out:
        result["path"] = lm.save_checkpoint(out, model, tokenizer)
    parts.unpersist()
    return result


def tune_instructions(model: lm.GPT, tokenizer: Tokenizer, examples: DataFrame, out: str | Path | None = None, steps: int = 100, max_len: int | None = None) -> dict:
    """Answers before, tuning, answers after, exact matches, checkpoint."""
    batches = lm.padded_batches(lm.encode_examples(examples, tokenizer, max_len or model.config.max_seq_len))
    losses = lm.finetune(model, batches, steps)
    after = examples.withColumn("answer", lm.answers(examples, model, tokenizer))
    exact = after.agg(F.count_if(F.col("answer") == U.trim_ws("output")).alias("n")).first().n
    if out:
        lm.save_checkpoint(out, model, tokenizer, "instruct")
    return {"losses": losses, "answers": after, "exact": exact}


# The decoding settings that are compared, and the prompts.
CANDIDATES = [
    {"name": "greedy", "temperature": 0.0},
    {"name": "t=0.5 k=10", "temperature": 0.5, "top_k": 10},
    {"name": "t=0.6 k=20", "temperature": 0.6, "top_k": 20},
    {"name": "t=0.6 p=0.9", "temperature": 0.6, "top_p": 0.9},
    {"name": "t=0.7 k=40", "temperature": 0.7, "top_k": 40},
    {"name": "t=0.7 p=0.95", "temperature": 0.7, "top_p": 0.95},
    {"name": "t=0.8 p=0.9", "temperature": 0.8, "top_p": 0.9},
    {"name": "t=0.8 p=0.9 rep=1.15", "temperature": 0.8, "top_p": 0.9, "repetition_penalty": 1.15},
    {"name": "t=1.0 k=40", "temperature": 1.0, "top_k": 40},
]
PROMPTS = ["ភ្នំពេញ", "ប្រទេសកម្ពុជា", "ប្រវត្តិសាស្ត្រ"]
#: Characters of each real text that are measured, about as many as are generated.
REAL_CHARS = 200


def tune_sampling(model: lm.GPT, tokenizer: Tokenizer, corpus: DataFrame, prompts: list[str] | None = None, seeds: int = 3, length: int = 40) -> DataFrame:
    """(name, grounding, diversity, distance) per setting, the nearest first: how far the grounding (3-grams) and the
    diversity (2-grams) of what it generates after the prompts lie from those of the beginnings of the corpus' own texts.
    Settings, prompts and seeds are a stated grid; generation runs on the executors."""
    spark = corpus.sparkSession
    grid = [(i, p, r) for i in range(len(CANDIDATES)) for p in (prompts or PROMPTS) for r in range(seeds)]
    jobs = spark.createDataFrame(grid, "setting int, prompt string, seed int").repartition(len(CANDIDATES)).withColumn("job", F.monotonically_increasing_id())
    shared = spark.sparkContext.broadcast((model, tokenizer))

    def answered(model: lm.GPT, tokenizer: Tokenizer, setting: int, prompt: str, seed: int) -> str:
        asked, own = tokenizer.encode(prompt), CANDIDATES[setting]
        full = model.generate(asked, length, own["temperature"], own.get("top_k"), own.get("top_p"), own.get("repetition_penalty", 1.0), rng=np.random.default_rng(seed))
        return tokenizer.decode(full[len(asked) :])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[answered(*shared.value, *job) for job in zip(pdf["setting"], pdf["prompt"], pdf["seed"], strict=True)])

    made = jobs.mapInPandas(run, "setting int, prompt string, seed int, job bigint, text string").persist()
    grounding = evaluate.Grounding(corpus, orders=(3,))

    def measured(texts: DataFrame, *by: str) -> DataFrame:
        ratio = grounding.score(texts, "job").select("job", "ratio").join(texts.select("job", *by, U.distinct_n("text", 2).alias("diverse")), "job")
        return ratio.groupBy(*by).agg(F.avg("ratio").alias("grounding"), F.avg("diverse").alias("diversity"))

    real = measured(corpus.where("text is not null").select(F.monotonically_increasing_id().alias("job"), F.substring("text", 1, REAL_CHARS).alias("text"))).first()
    names = F.array(*[F.lit(c["name"]) for c in CANDIDATES])
    away = F.hypot(F.col("grounding") - F.lit(real.grounding or 0.0), F.col("diversity") - F.lit(real.diversity or 0.0))
    return measured(made, "setting").select(F.get(names, F.col("setting")).alias("name"), "grounding", "diversity", away.alias("distance")).orderBy("distance", "name")
