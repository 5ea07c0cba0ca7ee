"""Retrieval metrics against gold spans.

Returned chunks are question_id, rank, doc_id, start_char, end_char; gold spans are
question_id, span_no, doc_id, start_char, end_char; both half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.start_char") < F.col(f"{b}.end_char")) & (F.col(f"{b}.start_char") < F.col(f"{a}.end_char"))


def gold_ranks(returned: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, span_no, gold_rank: the first chunk that overlaps each span, null if none."""
    joined = gold.alias("g").join(returned.alias("c"), (F.col("c.question_id") == F.col("g.question_id")) & _overlap("c", "g"), "left")
    return joined.groupBy("g.question_id", "g.span_no").agg(F.min("c.rank").alias("gold_rank"))


def relevance(returned: DataFrame, gold: DataFrame) -> DataFrame:
    """``returned`` with ``hit``: whether a chunk overlaps a span of its question."""
    spans = gold.select("question_id", "doc_id", F.col("start_char").alias("_s"), F.col("end_char").alias("_e"))
    hits = returned.join(spans, ["question_id", "doc_id"]).where((F.col("start_char") < F.col("_e")) & (F.col("_s") < F.col("end_char"))).select("question_id", "rank").distinct().withColumn("hit", F.lit(True))
    return returned.join(hits, ["question_id", "rank"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def span_scores(ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """question_id, metric, value: recall@k and full_support@k."""
    parts = []
    for k in ks:
        found = F.coalesce(F.col("gold_rank") <= k, F.lit(False))
        parts += [F.avg(found.cast("double")).alias(f"recall@{k}"), F.min(found.cast("int")).cast("double").alias(f"full_support@{k}")]
    return long_format(ranks.groupBy("question_id").agg(*parts))


def long_format(wide: DataFrame, key: str = "question_id") -> DataFrame:
    names = [c for c in wide.columns if c != key]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in names])
    return wide.select(key, F.explode(pairs).alias("x")).select(key, "x.metric", "x.value")


def rank_scores(flagged: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """question_id, mrr, ndcg at ``k``.  ``flagged``: question_id, rank, hit; ``totals``: question_id, total relevant in the whole index."""
    top = flagged.where(F.col("rank") <= k)
    gain = F.when(F.col("hit"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    own = top.groupBy("question_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.when(F.col("total") > 0, F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    rows = totals.join(own, "question_id", "left").withColumn("ideal", ideal)
    return rows.select("question_id", F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def count_relevant(index: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, total: distinct spans of the index (doc_id, start_char, end_char) that overlap a gold span."""
    spans = index.select("doc_id", "start_char", "end_char").distinct()
    joined = gold.alias("g").join(spans.alias("c"), _overlap("c", "g"), "left")
    return joined.groupBy("g.question_id").agg(F.countDistinct("c.doc_id", "c.start_char", "c.end_char").alias("total"))


def spans_not_contained(index: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold spans that no chunk holds whole."""
    inside = (F.col("c.doc_id") == F.col("g.doc_id")) & (F.col("c.start_char") <= F.col("g.start_char")) & (F.col("g.end_char") <= F.col("c.end_char"))
    return gold.alias("g").join(index.alias("c"), inside, "left_anti")


def spans_cut(index: DataFrame, gold: DataFrame) -> DataFrame:
    """The gold spans inside which a chunk begins."""
    cut = (F.col("c.doc_id") == F.col("g.doc_id")) & (F.col("g.start_char") < F.col("c.start_char")) & (F.col("c.start_char") < F.col("g.end_char"))
    return gold.alias("g").join(index.alias("c"), cut, "left_semi")


def within_budget(returned: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """Whole chunks in rank order and the first ``room`` tokens of the one that crosses the budget; what is below goes."""
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = returned.withColumn("_t", tokens).withColumn("room", F.lit(budget) - before).where("room > 0")
    return rows.withColumn("tokens_kept", F.least("_t", "room")).drop("_t")


def cut_to_tokens(text: Column, kept: Column) -> Column:
    """The code points of the first ``kept`` runs of visible characters with the space before each."""
    return F.length(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), F.lit(1), kept.cast("int")), "")).cast("long")


def covered_chars(ranges: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, span_no, covered: characters of each gold span in the union of the ranges."""
    clipped = gold.alias("g").join(ranges.alias("c"), (F.col("c.question_id") == F.col("g.question_id")) & _overlap("c", "g")).select("g.question_id", "g.span_no", F.greatest("c.start_char", "g.start_char").alias("s"), F.least("c.end_char", "g.end_char").alias("e"))
    line = Window.partitionBy("question_id", "span_no").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(line), F.col("s"))))
    return clipped.withColumn("fresh", fresh).groupBy("question_id", "span_no").agg(F.sum("fresh").alias("covered"))


def budget_scores(ranges: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, recall (spans touched), precision (gold characters of retrieved ones, repeats counted below the line)."""
    own = covered_chars(ranges, gold)
    spans = gold.select("question_id", "span_no").join(own, ["question_id", "span_no"], "left").groupBy("question_id").agg(F.avg((F.coalesce("covered", F.lit(0)) > 0).cast("double")).alias("recall"), F.sum(F.coalesce("covered", F.lit(0))).alias("gold_chars"))
    size = ranges.groupBy("question_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))
    return spans.join(size, "question_id", "left").select("question_id", "recall", F.coalesce(F.try_divide(F.col("gold_chars").cast("double"), F.nullif("chars", F.lit(0))), F.lit(0.0)).alias("precision"))


def context_scores(passages: DataFrame, contents: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, metric, value of assembled contexts: their size, the share of the gold spans that they touch, and whether that is all.

    ``passages``: question_id, doc_id, start_char, end_char, rank; ``contents``: question_id and sizes.
    """
    sizes = long_format(contents.select("question_id", *[F.col(c).cast("double").alias(c) for c in contents.columns if c != "question_id"]))
    found = gold_ranks(passages, gold).withColumn("held", F.col("gold_rank").isNotNull())
    own = found.groupBy("question_id").agg(F.avg(F.col("held").cast("double")).alias("context_recall"), F.min(F.col("held").cast("int")).cast("double").alias("context_full_support"))
    return sizes.unionByName(long_format(own))


def by_group(scores: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """metric, group (null: all), mean, n, in one pass over grouping sets.  ``scores``: question_id, metric, value."""
    rows = scores.join(groups, "question_id").where("value is not null")
    return rows.groupingSets([["metric"], ["metric", group]], "metric", group).agg(F.avg("value").alias("mean"), F.count("*").alias("n"), F.grouping(group).alias("overall"))
