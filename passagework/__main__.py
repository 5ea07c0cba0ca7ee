"""``python -m passagework prepare|ingest|ask|eval|compare``: the pipeline from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .operators import dataset, stats
from .plans import pipeline
from .plans import prepare as preparing
from .sources import tables


def settings_of(path: str | None) -> pipeline.Settings:
    if not path:
        return pipeline.Settings()
    with open(path, encoding="utf-8") as f:
        return pipeline.Settings.load(f.read())


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="passagework")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, **more) -> argparse.ArgumentParser:
        own = commands.add_parser(name, **more)
        for n in names:
            own.add_argument(n)
        return own

    one = command("prepare", "corpus", "questions", "out", help="documents, splits and a manifest from raw files")
    for name in ("dev", "test", "subset"):
        one.add_argument(f"--{name}", type=int, required=True)
    one = command("ingest", "documents", "index", help="cut documents that the index lacks")
    one.add_argument("--settings")
    one = command("ask", "documents", "index", "question", help="answer one question")
    one.add_argument("--settings")
    one = command("eval", "documents", "index", "questions", "run", help="score a pipeline on questions with gold evidence")
    one.add_argument("--settings")
    one.add_argument("--budget", type=int, default=2000)
    one.add_argument("--held-out", action="store_true")
    command("compare", "run_a", "run_b", "metric", help="paired difference of two runs")
    return out


def main(argv: list[str] | None = None, spark=None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or pipeline.session()
    if args.command == "prepare":
        out = preparing.prepare(spark, args.corpus, args.questions, args.out, preparing.Preparation(args.dev, args.test, args.subset))
    elif args.command == "compare":
        runs = [spark.read.parquet(f"{run}/scores").where(F.col("metric") == args.metric) for run in (args.run_a, args.run_b)]
        pairs = stats.paired(*runs)
        out = stats.flips(pairs).first().asDict()
    else:
        own = settings_of(args.settings)
        documents = tables.read_documents(spark, args.documents)
        if "metadata" in documents.columns:
            documents = documents.select("doc_id", "text", "metadata.title", "metadata.source", "metadata.published_at")
        if args.command == "ingest":
            out = pipeline.ingest(documents, own, args.index)
        else:
            index = tables.load_index(spark, args.index, own.index_settings())
            if args.command == "ask":
                asked = spark.createDataFrame([("q", args.question)], "question_id string, question string")
                out = pipeline.ask(asked, documents, index, own).first().asDict()
            else:
                pipeline.guard_split(args.questions, args.held_out)
                questions = dataset.answerable(tables.read_questions(spark, args.questions))
                gold = tables.evidence(questions)
                scores = tables.checkpointed(pipeline.evaluate(questions.select("question_id", F.col("text").alias("question")), gold, index, own, budget=args.budget, documents=documents))
                pipeline.save_run(scores, args.run, own, rows=questions)
                means = pipeline.summary(scores, questions.select("question_id", "cluster"))
                out = {r["metric"]: {k: r[k] for k in ("mean", "low", "high", "n")} for r in means.collect()}
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
