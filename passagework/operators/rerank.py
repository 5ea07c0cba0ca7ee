"""Reordering of ranked lists by new scores.  A list is question_id, key, rank."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import fusion


def reorder(scored: DataFrame, decimals: int = 9) -> DataFrame:
    """By ``new_score``, then by the old rank."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("new_score", decimals)), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))


def head_and_tail(scored: DataFrame, depth: int, k: int) -> DataFrame:
    """The first ``depth`` by new score, the others below them in their old order, cut at ``k``."""
    head = F.col("rank") <= depth
    order = Window.partitionBy("question_id").orderBy(F.desc(head), F.desc(F.when(head, F.round("new_score", 9))), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def merge_max(results: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """Several scorings of a question's chunks (score, rank): the best score of each, ties by the best rank."""
    merged = results.groupBy("question_id", key).agg(F.max("score").alias("score"), F.min("rank").alias("old"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "old", key)
    out = merged.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select("question_id", key, "score", "rank")


def merge_round_robin(results: DataFrame, key: str, k: int | None = None) -> DataFrame:
    return fusion.round_robin(results, key, k)


def overlap_scorer(questions: pd.Series, passages: pd.Series) -> pd.Series:
    """A deterministic stand-in for a model: the share of the question's words that the passage has."""
    def share(q: str, p: str) -> float:
        own = {*q.lower().split()}
        return len(own & {*p.lower().split()}) / len(own) if own else 0.0

    return pd.Series([share(q or "", p or "") for q, p in zip(questions, passages, strict=True)])


def score_pairs(pairs: DataFrame, cache: DataFrame | None = None, scorer: Callable = overlap_scorer) -> DataFrame:
    """pairs (question, passage, ...) with new_score; each distinct pair that the cache (key, new_score) lacks is scored once."""
    scored = F.pandas_udf(scorer, "double")
    keyed = pairs.withColumn("key", F.sha2(F.concat_ws("\0", "question", "passage"), 256))
    distinct = keyed.select("key", "question", "passage").dropDuplicates(["key"])
    if cache is None:
        return keyed.join(distinct.select("key", scored("question", "passage").alias("new_score")), "key").drop("key")
    fresh = distinct.join(cache, "key", "left_anti").select("key", scored("question", "passage").alias("new_score"))
    return keyed.join(cache.select("key", "new_score").unionByName(fresh), "key").drop("key")


# --- model scorers ------------------------------------------------------------------------


@dataclass(frozen=True)
class ClassifierScorer:
    """The first logit of a classifier of pairs.  ``logits(questions, passages)`` gives a row per pair; ``longest``: words that it reads of both."""

    logits: Callable[[list[str], list[str]], np.ndarray]
    longest: int | None = None

    def cut(self, question: str, passage: str) -> tuple[str, str, bool]:
        """The longer of the two loses words at its end until both fit."""
        q, p = question.split(), passage.split()
        if self.longest is None or len(q) + len(p) <= self.longest:
            return question, passage, False
        if len(q) > len(p):
            q = q[: max(len(p), self.longest - len(p))]
        p = p[: max(0, self.longest - len(q))]
        q = q[: self.longest - len(p)]
        return " ".join(q), " ".join(p), True

    def score(self, questions: list[str], passages: list[str]) -> np.ndarray:
        return np.asarray(self.logits(questions, passages), np.float32)[:, 0]


@dataclass(frozen=True)
class YesNoScorer(ClassifierScorer):
    """A language model's logit of "yes" less that of "no" after a prompt with both texts; ``logits`` gives (yes, no) per pair."""

    instruction: str = "Does the passage answer the question?"

    def score(self, questions: list[str], passages: list[str]) -> np.ndarray:
        asked = [f"{self.instruction}\nQuestion: {q}" for q in questions]
        both = np.asarray(self.logits(asked, passages), np.float32)
        return both[:, 0] - both[:, 1]


def cross_encoded(pairs: DataFrame, scorer: ClassifierScorer, cache: DataFrame | None = None, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """(pairs with new_score and truncated; the cache's new rows: key, new_score, truncated).

    ``pairs``: question, passage, ...  Each distinct pair that the cache lacks is
    scored once, in batches of pairs of similar length.
    """

    @F.pandas_udf("struct<new_score:double,truncated:boolean>")
    def scored(questions: pd.Series, passages: pd.Series) -> pd.DataFrame:
        cut = [scorer.cut(q or "", p or "") for q, p in zip(questions, passages, strict=True)]
        by = sorted(range(len(cut)), key=lambda i: len(cut[i][0]) + len(cut[i][1]))
        out = np.zeros(len(cut))
        for at in range(0, len(by), batch):
            own = by[at : at + batch]
            out[own] = scorer.score([cut[i][0] for i in own], [cut[i][1] for i in own])
        return pd.DataFrame({"new_score": out, "truncated": [c[2] for c in cut]})

    keyed = pairs.withColumn("key", F.sha2(F.concat_ws("\0", "question", "passage"), 256))
    compute = lambda rows: rows.select("key", scored("question", "passage").alias("s")).select("key", "s.*")
    if cache is None:
        fresh = compute(keyed.dropDuplicates(["key"]))
        return keyed.join(fresh, "key").drop("key"), fresh
    both, fresh = tables.through_cache(keyed, cache, compute)
    return both.drop("key"), fresh


def merged_notes(notes: DataFrame) -> DataFrame:
    """question_id with the notes of several scorings as one: seconds and counts are added, ``cached`` only if all were, flags if any was."""
    kinds = dict(notes.dtypes)
    how = {c: F.bool_and(c) if c == "cached" else F.bool_or(c) if k == "boolean" else F.last(c) if k == "string" else F.sum(c) for c, k in kinds.items() if c != "question_id"}
    return notes.groupBy("question_id").agg(*[v.alias(c) for c, v in how.items()])


def clause_orders(scored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """order (best, round_robin), question_id, key, score, rank of candidates that each clause of their question has scored.

    ``scored``: question_id, query_no, key, rank, new_score.  The best score over
    the clauses, or the clauses' own orders interleaved.
    """
    best = merge_max(scored.select("question_id", key, F.col("new_score").alias("score"), "rank"), key).withColumn("order", F.lit("best"))
    own = Window.partitionBy("question_id", "query_no").orderBy(F.desc(F.round("new_score", 9)), "rank")
    lists = scored.select("question_id", F.col("query_no").alias("list_no"), key, F.row_number().over(own).alias("rank"), F.col("new_score").alias("score"))
    return best.unionByName(fusion.round_robin(lists, key).withColumn("order", F.lit("round_robin")))
