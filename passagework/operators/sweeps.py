"""Tables that compare runs and settings: one row per run, with paired differences from a reference run.

A run's scores are run, question_id, metric, value; a question's kind and evidence
cluster come from ``questions`` (question_id, question_type, cluster).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dataset, diagnostics, metrics, stats


def differences(scores: DataFrame, reference: str, clusters: DataFrame, by_type: bool = False, samples: int = 2000, seed: int = 0) -> DataFrame:
    """run, metric (and question_type), difference, low, high, n: each run less the reference run, question by question."""
    own = scores.where(F.col("run") != reference).select("run", "question_id", "metric", F.col("value").alias("a"))
    base = scores.where(F.col("run") == reference).select("question_id", "metric", F.col("value").alias("b"))
    rows = own.join(base, ["question_id", "metric"]).where("a is not null and b is not null").withColumn("gap", F.col("a") - F.col("b")).join(clusters, "question_id")
    group = ["run", "metric", *(["question_type"] if by_type else [])]
    return stats.bootstrap(rows, group, "cluster", "gap", samples, seed).withColumnRenamed("mean", "difference")


def run_table(scores: DataFrame, reference: str, questions: DataFrame, names: list[str], samples: int = 2000, seed: int = 0) -> DataFrame:
    """run, metric, mean, n, difference, low, high of the metrics ``names``; the reference run has no difference."""
    own = scores.where(F.col("metric").isin(*names) & F.col("value").isNotNull())
    means = own.groupBy("run", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    gaps = differences(own, reference, questions.select("question_id", "cluster"), samples=samples, seed=seed).drop("n")
    return means.join(gaps, ["run", "metric"], "left")


def type_table(scores: DataFrame, reference: str, questions: DataFrame, metric: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """run, question_type, mean, n, difference, low, high of one metric."""
    own = scores.where((F.col("metric") == metric) & F.col("value").isNotNull())
    kinds = questions.select("question_id", "question_type", "cluster")
    means = own.join(kinds, "question_id").groupBy("run", "question_type").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    gaps = differences(own, reference, kinds, True, samples, seed).drop("metric", "n")
    return means.join(gaps, ["run", "question_type"], "left")


def index_table(chunks: DataFrame, gold: DataFrame, tokens: Column, limit: int) -> DataFrame:
    """run, n_chunks, mean_tokens, spans_cut of several indexes.  ``chunks``: run, doc_id, start_char, end_char, ...

    A gold span is cut if no chunk of the run holds it whole.
    """
    rows = chunks.withColumn("_t", tokens)
    sizes = rows.groupBy("run").agg(F.count("*").alias("n_chunks"), F.avg("_t").alias("mean_tokens"), F.count_if(F.col("_t") >= limit).alias("at_limit"))
    spans = gold.select("doc_id", F.col("start_char").alias("_s"), F.col("end_char").alias("_e")).distinct()
    held = chunks.join(spans, "doc_id").where((F.col("start_char") <= F.col("_s")) & (F.col("_e") <= F.col("end_char"))).select("run", "doc_id", "_s", "_e").distinct()
    counted = held.groupBy("run").agg(F.count("*").alias("_held"))
    total = spans.agg(F.count("*").alias("_spans"))
    return sizes.join(counted, "run", "left").crossJoin(total).select("run", "n_chunks", "mean_tokens", "at_limit", (F.col("_spans") - F.coalesce("_held", F.lit(0))).alias("spans_cut"))  # one row


def timings(rows: DataFrame, group: list[str], seconds: str = "seconds") -> DataFrame:
    """group, n, median, p95 (nearest rank) of measured times."""
    keyed = rows.withColumn("_g", F.struct(*group))
    top = dataset.nearest_rank(keyed, "_g", seconds, [95]).select("_g", F.col("value").alias("p95"))
    own = keyed.groupBy("_g").agg(F.count(seconds).alias("n"), F.median(seconds).alias("median"))
    return own.join(top, "_g").select("_g.*", "n", "median", "p95")


def index_stats(vectors: DataFrame) -> DataFrame:
    """vectors, dimensions, bytes (4 for each number) of a store's vectors."""
    size = F.size("vector")
    return vectors.agg(F.count("*").alias("vectors"), F.max(size).alias("dimensions"), (F.sum(size) * 4).alias("bytes"))


def stepwise(scores: DataFrame, steps: list[list[str]]) -> dict:
    """The settings that a staged search chooses: each step takes the best mean over its own settings, those of earlier steps held at their choice.

    ``scores``: a column per setting, ordinal, value; ties go to the smaller ordinal.
    A step's row counts only if the settings of later steps are null (not tried yet).
    """
    chosen: dict = {}
    for n, names in enumerate(steps):
        rows = scores
        for name, value in chosen.items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        for later in (name for step in steps[n + 1 :] for name in step):
            rows = rows.where(F.col(later).isNull())
        best = diagnostics.best_setting(rows.where(F.expr(" and ".join(f"`{name}` is not null" for name in names))), names).first()
        if best is None:
            raise ValueError(f"no scores for {', '.join(names)}")
        chosen |= {name: best[name] for name in names}
    return chosen


def followups_passed(rewritten: DataFrame) -> DataFrame:
    """One row: n, passed.  ``rewritten``: asked, question, must (terms that the rewritten question has to name; none: it must come back unchanged)."""
    named = F.forall("must", lambda t: F.contains(F.lower("question"), F.lower(t)))
    ok = F.when(F.size("must") > 0, named).otherwise(F.col("question") == F.col("asked"))
    return rewritten.agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"))


def first_of_each(rows: DataFrame, kind: str, order: str, each: int = 1) -> DataFrame:
    """The first ``each`` rows of each kind."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= each).drop("_n")


def tokens_in_prompt(rows: DataFrame) -> DataFrame:
    """run, tokens: mean input tokens of the answered questions (run, input_tokens: null where there was no call)."""
    return rows.groupBy("run").agg(F.coalesce(F.avg("input_tokens"), F.lit(0.0)).alias("tokens"))


def outcomes(notes: DataFrame) -> DataFrame:
    """run, questions, refused, repaired, cut_short: what went wrong in reranking (flags, null: no)."""
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c)
    return notes.groupBy("run").agg(F.count("*").alias("questions"), flag("refused"), flag("repaired"), flag("cut_short"))


def gold_sentences(gold: DataFrame, documents: DataFrame, questions: DataFrame, terms, ranks: dict[str, DataFrame]) -> DataFrame:
    """question_id, span_no, sentence, overlap and a rank column per run: each gold sentence with where every run has it (null: nowhere).

    ``terms(column)`` gives a text's terms; ``ranks``: name -> question_id, span_no, gold_rank.
    """
    cut = F.substring(F.col("text"), (F.col("start_char") + 1).cast("int"), (F.col("end_char") - F.col("start_char")).cast("int"))
    rows = gold.join(documents.select("doc_id", "text"), "doc_id").select("question_id", "span_no", cut.alias("sentence")).join(questions.select("question_id", "question"), "question_id")
    rows = rows.select("question_id", "span_no", "sentence", diagnostics.term_overlap(terms(F.col("sentence")), terms(F.col("question"))).alias("overlap"))
    for name, own in ranks.items():
        rows = rows.join(own.select("question_id", "span_no", F.col("gold_rank").alias(name)), ["question_id", "span_no"], "left")
    return rows


def failures(sentences: DataFrame, first: str = "dense", second: str = "sparse", fused: str = "hybrid", near: int = 10, far: int = 50, prompt: int = 20) -> DataFrame:
    """``sentences`` with kind and order, once for each kind of failure: what one list finds and the other misses, what both miss, what fusion loses."""
    a, b, c = (F.col(x) for x in (first, second, fused))
    beyond = far + 1
    place = lambda x: F.coalesce(x, F.lit(beyond))
    kinds = {
        f"{first} misses": (b <= near) & a.isNull(),
        f"{second} misses": (a <= near) & b.isNull(),
        "both miss": a.isNull() & b.isNull(),
        "fusion loses": (F.least(place(a), place(b)) <= near) & (a.isNull() | b.isNull()) & (c.isNull() | (c > prompt)),
    }
    order = {f"{first} misses": b.cast("double"), f"{second} misses": a.cast("double"), "both miss": F.col("overlap"), "fusion loses": -place(c).cast("double")}
    every = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("kind"), order[k].alias("order"))) for k, test in kinds.items()])
    return sentences.withColumn("_x", F.explode(F.filter(every, lambda x: x.isNotNull()))).select(*sentences.columns, "_x.kind", "_x.order")


def context_table(contexts: dict[str, DataFrame], gold: DataFrame, clusters: DataFrame, plain: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """run, metric, mean, n, difference, low, high of context settings: what each assembles holds of the gold, against the plain one.

    ``contexts``: name -> passages (question_id, rank, doc_id, start_char, end_char) of all questions.
    """
    scores = None
    for name, passages in contexts.items():
        found = metrics.gold_ranks(passages, gold).withColumn("held", F.col("gold_rank").isNotNull())
        own = found.groupBy("question_id").agg(F.avg(F.col("held").cast("double")).alias("context_recall"), F.min(F.col("held").cast("int")).cast("double").alias("context_full_support"))
        rows = metrics.long_format(own).withColumn("run", F.lit(name))
        scores = rows if scores is None else scores.unionByName(rows)
    return run_table(scores, plain, clusters, ["context_recall", "context_full_support"], samples, seed)


def disagreements(pairs: DataFrame, judge: str = "judge", human: str = "human") -> DataFrame:
    """The rows on which judge and human differ, with ``verdict``: too_kind or too_harsh."""
    rows = pairs.where(F.col(judge).isNotNull() & F.col(human).isNotNull() & (F.col(judge) != F.col(human)))
    return rows.withColumn("verdict", F.when(F.col(judge), "too_kind").otherwise("too_harsh"))
