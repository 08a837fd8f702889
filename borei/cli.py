"""Command line: ``python -m borei.cli TEXT`` and the demos."""

from __future__ import annotations

import argparse
import sys

from borei.session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="borei", description=__doc__)
    parser.add_argument("text", nargs="?", help="a text to analyze (default: standard input)")
    parser.add_argument("--segment", metavar="LEXICON", help="segment by this lexicon (JSON lines)")
    parser.add_argument("--benchmark", nargs="?", const="", metavar="CASES", help="score the structural cases, and those of a file by echo")
    parser.add_argument("--checkpoint", help="a model that answers the cases of the file")
    parser.add_argument("--compare-tokenizers", type=int, nargs="?", const=100, metavar="VOCAB")
    parser.add_argument("--train-demo", type=int, nargs="?", const=150, metavar="STEPS")
    parser.add_argument("--export-db", metavar="PATH")
    args = parser.parse_args(argv)
    if args.export_db:
        from borei.sources.io import export_characters

        export_characters(args.export_db)
        return 0
    spark = build_session("borei-cli", **{"spark.ui.showConsoleProgress": "false"})
    from pyspark.sql import functions as F

    from borei.operators import evaluate, lm, tokenizers

    sample = lambda: spark.createDataFrame(list(enumerate(tokenizers.SAMPLE)), "id bigint, text string")
    if args.compare_tokenizers:
        print(tokenizers.format_comparison(tokenizers.compare({n: k() for n, k in tokenizers.KINDS.items()}, sample(), vocab_size=args.compare_tokenizers)))
    elif args.train_demo:
        tokenizer = tokenizers.GraphemeTokenizer().train(sample())
        model = lm.GPT(lm.GPTConfig(len(tokenizer.vocab), max_seq_len=32))
        result = lm.train(model, lm.encode_corpus(sample(), tokenizer), steps=args.train_demo, seq_len=16)
        print(f"{model.num_parameters()} parameters, loss {result.of('loss')[0]:.3f} to {result.last('loss'):.3f}")
        print(tokenizer.decode(model.generate(tokenizer.encode("កម្ពុជា"), 30, 0.8, 10)))
    elif args.benchmark is not None:
        print(evaluate.format_benchmark(evaluate.run_benchmark(evaluate.structural_cases(spark), evaluate.structural_prediction())))
        if args.benchmark:
            from borei.sources.io import read_cases

            cases = read_cases(spark, args.benchmark)
            print(evaluate.format_benchmark(evaluate.run_benchmark(cases, F.col("input"))))
            if args.checkpoint:
                model, tokenizer = lm.load_checkpoint(args.checkpoint)
                asked = cases.withColumnRenamed("input", "instruction").withColumn("input", F.lit(""))
                answered = asked.withColumn("answer", lm.answers(asked, model, tokenizer)).drop("input").withColumnRenamed("instruction", "input")
                print(evaluate.format_benchmark(evaluate.run_benchmark(answered, F.col("answer"))))
    else:
        from borei.plans import analyzer

        df = spark.createDataFrame([(0, args.text if args.text is not None else sys.stdin.read())], "id int, text string")
        if args.segment:
            from borei.operators.lexicon import Lexicon
            from borei.sources.io import read_lexicon

            for row in analyzer.segment(df, Lexicon(read_lexicon(spark, args.segment)), "id").orderBy("pos").collect():
                print(analyzer.grammar_report(row), f"\n  coverage: {row.coverage:.0%}\n  " + " ".join(f"{w.text}/{w.pos or '?'}" for w in row.words))
        else:
            print(analyzer.report(analyzer.analyze(df, "id").first()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
