"""Comparing runs and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_overlap(own: Column, asked: Column) -> Column:
    """Share of the distinct terms of a text that the question has; 0 without terms."""
    mine = F.array_distinct(own)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, asked)).cast("double"), F.nullif(F.size(mine), F.lit(0))), F.lit(0.0))


def found_by(ranks: DataFrame, depth: int) -> DataFrame:
    """found (both, first only, second only, neither), spans, median_overlap.  ``ranks``: first, second (nullable ranks), overlap."""
    a, b = (F.coalesce(F.col(c) <= depth, F.lit(False)) for c in ("first", "second"))
    name = F.when(a & b, "both").when(a, "first only").when(b, "second only").otherwise("neither")
    return ranks.withColumn("found", name).groupBy("found").agg(F.count("*").alias("spans"), F.median("overlap").alias("median_overlap"))


def three_way(first: DataFrame, second: DataFrame, fused: DataFrame) -> DataFrame:
    """question_id, winner (first, second, tie), fused_gain: the fused run's value less the better one.  Each run: question_id, value."""
    rows = first.withColumnRenamed("value", "a").join(second.withColumnRenamed("value", "b"), "question_id").join(fused.withColumnRenamed("value", "c"), "question_id")
    return rows.select("question_id", F.when(F.col("a") > F.col("b"), "first").when(F.col("b") > F.col("a"), "second").otherwise("tie").alias("winner"), (F.col("c") - F.greatest("a", "b")).alias("fused_gain"))


def fusion_losses(compared: DataFrame) -> DataFrame:
    """Questions on which fusing lost to the better single run."""
    return compared.where("fused_gain < -1e-9")


def moved(final: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """The final list with each chunk's rank in every source list, one column per list (null: not there).  ``sources``: question_id, list_no, key, rank."""
    wide = sources.groupBy("question_id", key).agg(F.map_from_entries(F.collect_list(F.struct("list_no", "rank"))).alias("found"))
    return final.join(wide, ["question_id", key], "left")


def best_setting(scores: DataFrame, settings: list[str]) -> DataFrame:
    """The row of settings with the highest mean value; ties to the first in the order of ``ordinal``."""
    means = scores.groupBy("ordinal", *settings).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    return means.orderBy(F.desc(F.round("mean", 9)), "ordinal").limit(1)


def picked(rows: DataFrame, kind: str, cluster: str, order: str, each: int = 5, sentence: str | None = None) -> DataFrame:
    """Up to ``each`` examples of each kind, in order, of which no two share a cluster (nor a ``sentence``, if given).

    Without ``sentence`` these are the first of each cluster.  With it a row may be
    barred by either, so the first row that is still free is taken ``each`` times;
    what was taken (a row per kind and round) bars the rest.
    """
    if sentence is None:
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind, cluster).orderBy(order))).where("_n = 1")
        return first.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("_n") <= each).drop("_n")
    spark, out = rows.sparkSession, []
    free = rows
    for _ in range(each):
        best = free.groupBy(kind).agg(F.min(F.struct(order, *[c for c in rows.columns if c != order])).alias("x")).select("x.*").select(rows.columns).collect()
        if not best:
            break
        out += best
        taken = F.broadcast(spark.createDataFrame(best, rows.schema))  # a row per kind
        for barred in (cluster, sentence):
            free = free.join(taken.select(kind, barred).distinct(), [kind, barred], "left_anti").select(rows.columns)
    return spark.createDataFrame(out, rows.schema)


def gains(scored: DataFrame) -> DataFrame:
    """hit, median_gain: how much the best part's score is above the whole question's, for gold and other chunks.  ``scored``: hit, whole, best."""
    return scored.groupBy("hit").agg(F.median(F.col("best") - F.col("whole")).alias("median_gain"), F.count("*").alias("n"))


def evidence_profile(spans: DataFrame, documents: DataFrame, parts: int = 5) -> DataFrame:
    """part (from 0), n: in which part of its document each gold span begins."""
    placed = spans.join(documents.select("doc_id", F.length("text").alias("_l")), "doc_id").where("_l > 0")
    at = F.least(F.lit(parts - 1), F.floor(F.col("start_char") * parts / F.col("_l")))
    return placed.select(at.cast("int").alias("part")).groupBy("part").agg(F.count("*").alias("n"))


def evidence_counts(spans: DataFrame) -> DataFrame:
    """kind (spans, documents), each, questions: how many gold spans, and documents with one, the answerable questions have."""
    own = spans.groupBy("question_id").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("each")) for k in ("spans", "documents")])
    return own.select(F.explode(pairs).alias("x")).select("x.*").groupBy("kind", "each").agg(F.count("*").alias("questions"))


def evidence_coverage(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: distinct spans, documents that hold one, all documents, and the spans' share of all characters (overlaps count twice)."""
    distinct = spans.select("doc_id", "start_char", "end_char").distinct()
    gold = distinct.agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("holding"), F.coalesce(F.sum(F.col("end_char") - F.col("start_char")), F.lit(0)).alias("_gold"))
    every = documents.agg(F.count("*").alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("_all"))
    return gold.crossJoin(every).select("spans", "holding", "documents", F.coalesce(F.try_divide(F.col("_gold").cast("double"), F.col("_all")), F.lit(0.0)).alias("coverage"))  # two single rows


def evidence_uses(evidence: DataFrame, top: int = 10) -> DataFrame:
    """The spans that most questions share: span, uses."""
    return evidence.groupBy("span").agg(F.countDistinct("question_id").alias("uses")).orderBy(F.desc("uses"), "span").limit(top)


def parity(a: DataFrame, b: DataFrame, decimals: int = 6) -> DataFrame:
    """questions, same_scores, same_set, same_order of two ranked lists (question_id, key, rank, score)."""
    def lists(rows: DataFrame, name: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("rank", "key", F.round("score", decimals).alias("score"))))
        return rows.groupBy("question_id").agg(own.alias(name))

    both = lists(a, "x").join(lists(b, "y"), "question_id")
    same = lambda field: F.transform("x", lambda r: r[field]) == F.transform("y", lambda r: r[field])
    sets = F.array_sort(F.transform("x", lambda r: r["key"])) == F.array_sort(F.transform("y", lambda r: r["key"]))
    return both.agg(F.count("*").alias("questions"), F.count_if(same("score")).alias("same_scores"), F.count_if(sets).alias("same_set"), F.count_if(same("key")).alias("same_order"))
