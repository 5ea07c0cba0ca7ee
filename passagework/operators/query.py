"""Query transformation and the parsing of replies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Where a question is cut, and the words that a clause needs.
CLAUSE = re.compile(r",\s+|\s+(?:while|whereas|and|but|before|after)\s+")
LEAST_WORDS = 5


def clauses(question: str) -> list[str]:
    """Parts between commas and joining words.

    A part begins a clause if it has LEAST_WORDS words; the first part that is not
    blank begins one in any case, but if that clause stays short it takes the next
    one in.
    """
    breaks = list(CLAUSE.finditer(question))
    begins, ends = [0, *(m.end() for m in breaks)], [*(m.start() for m in breaks), len(question)]
    words = [len(question[a:b].split()) for a, b in zip(begins, ends, strict=True)]
    heads = [k for k, n in enumerate(words) if n >= LEAST_WORDS or n and not any(words[:k])]
    if len(heads) > 1 and len(question[begins[heads[0]] : ends[heads[1] - 1]].split()) < LEAST_WORDS:
        del heads[1]
    return [question[begins[a] : ends[b - 1]].strip() for a, b in zip(heads, [*heads[1:], len(words)], strict=False)]


def split_clauses(questions: DataFrame, limit: int | None = None) -> DataFrame:
    """question_id, query_no, text, role: all clauses; one clause is the question itself.

    With a ``limit`` only the first ones are returned, and ``extra`` says how many more there are.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clauses(t or ""))

    rows = questions.select("question_id", cut("question").alias("parts"))
    found = rows.select("question_id", F.posexplode("parts").alias("n", "text"), F.size("parts").alias("found"))
    out = ["question_id", (F.col("n") + 1).alias("query_no"), "text", F.when(F.col("found") > 1, "clause").otherwise("original").alias("role")]
    if limit is None:
        return found.select(*out)
    return found.where(F.col("n") < limit).select(*out, F.greatest(F.lit(0), F.col("found") - limit).alias("extra"))


def parse_lines(replies: DataFrame, limit: int) -> DataFrame:
    """question_id, query_no, text, repeated, extra: the lines of a reply without marks, each once, at most ``limit``."""
    rows = replies.select("question_id", F.posexplode(F.split("reply", r"\R")).alias("pos", "raw")).select("question_id", "pos", T.clean_line(F.col("raw")).alias("text")).where("text <> ''")
    keyed = rows.withColumn("key", T.text_key(F.col("text")))
    first = keyed.groupBy("question_id", "key").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"), F.count("*").alias("times"))
    own = Window.partitionBy("question_id")
    out = first.withColumns({"query_no": F.row_number().over(own.orderBy("pos")), "repeated": F.sum(F.col("times") - 1).over(own), "extra": F.greatest(F.lit(0), F.count("*").over(own) - limit)})
    return out.where(F.col("query_no") <= limit).select("question_id", "query_no", "text", "repeated", "extra")


def parse_passage(reply: Column) -> Column:
    """A reply that should be one passage, as one line."""
    lines = F.filter(F.split(reply, r"\R"), lambda x: F.trim(x) != "")
    return F.array_join(F.transform(lines, T.clean_line), " ")


def parse_ranking(replies: DataFrame) -> DataFrame:
    """question_id, place, passage (from 0), mentioned: a full order of passages 0 to n - 1 from a reply with numbers from 1.

    Numbers out of range are dropped, repeats count once, and passages that are
    never mentioned follow in their old order.
    """
    found = replies.select("question_id", "n", F.posexplode(F.regexp_extract_all("reply", F.lit(r"\d+"), F.lit(0))).alias("pos", "said")).select("question_id", "n", "pos", F.expr("try_cast(said AS int)").alias("number")).where("number between 1 and n")
    first = found.groupBy("question_id", (F.col("number") - 1).alias("passage")).agg(F.min("pos").alias("pos"))
    every = replies.where("n > 0").select("question_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("passage"))
    order = Window.partitionBy("question_id").orderBy(F.col("pos").asc_nulls_last(), "passage")
    return every.join(first, ["question_id", "passage"], "left").select("question_id", F.row_number().over(order).alias("place"), "passage", F.col("pos").isNotNull().alias("mentioned"))


def route(original: DataFrame, queries: DataFrame, which: str) -> DataFrame:
    """``original``, ``queries`` or ``both`` (the question first, and what repeats it left out).  question_id, query_no, text, role."""
    if which == "original":
        return original
    if which == "queries":
        return queries
    if which != "both":
        raise ValueError("which is original, queries or both")
    others = queries.join(original.select("question_id", "text"), ["question_id", "text"], "left_anti")
    return original.unionByName(others.withColumn("query_no", F.col("query_no") + 1))


def history(turns: DataFrame, keep: int = 3) -> DataFrame:
    """conv_id, turn, role, text, history: the last ``keep`` rows before each, as ``role: text`` lines."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-keep, -1)
    said = F.concat_ws(": ", "role", "text")
    return turns.withColumn("history", F.array_join(F.collect_list(said).over(before), "\n"))
