"""From a ranked list to passages and a prompt.

Chunks are question_id, rank, chunk_id, doc_id, start_char, end_char, text (offsets are
code points, half open); passages are question_id, rank, doc_id, start_char, end_char, text
and, if asked for, header.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import dense

# Prompt texts.
SYSTEM = "Answer the question from the passages alone."
HEADER_SYSTEM = SYSTEM + " Each passage begins with its title, source and date."
CLOSED_BOOK = "Answer the question from your own knowledge."


def dedupe(chunks: DataFrame) -> DataFrame:
    """The first chunk of each text that is the same but for case and white space; ranks stay."""
    own = Window.partitionBy("question_id", T.text_key(F.col("text"))).orderBy("rank")
    return chunks.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def min_max(score: Column, *group: str) -> Column:
    """Scores of a group in [0, 1]; all equal: 1."""
    own = Window.partitionBy(*group)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return F.when(high > low, (score - low) / (high - low)).otherwise(1.0)


def mmr_order(relevance: np.ndarray, similarity: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy choice by weight * relevance - (1 - weight) * largest similarity to what is chosen; ties to the lower index."""
    chosen: list[int] = []
    nearest = np.full(len(relevance), -np.inf)
    while len(chosen) < min(k, len(relevance)):
        value = weight * relevance - (1 - weight) * np.where(np.isinf(nearest), 0.0, nearest)
        if not chosen:
            value = relevance.astype(float).copy()
        value[chosen] = -np.inf
        chosen.append(int(np.argmax(value)))
        nearest = np.maximum(nearest, similarity[chosen[-1]])
    return chosen


def mmr(pool: DataFrame, key: str, k: int, weight: float = 0.5) -> DataFrame:
    """question_id, key, rank, of a bounded pool per question (question_id, key, rank, relevance, vector of length 1)."""
    kinds = dict(pool.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        v = np.stack(pdf["vector"].to_numpy())
        order = mmr_order(np.round(pdf["relevance"].to_numpy(float), 9), np.round(v @ v.T, 9), k, weight)
        out = pdf.iloc[order][["question_id", key]].copy()
        out["rank"] = np.arange(1, len(order) + 1, dtype=np.int32)
        return out

    return pool.groupBy("question_id").applyInPandas(choose, f"question_id {kinds['question_id']}, {key} {kinds[key]}, rank int")


def merge_neighbours(chunks: DataFrame) -> DataFrame:
    """Chunks of a document that touch or overlap become one span: question_id, doc_id, start_char, end_char, rank (the best), n_chunks.

    Gaps and islands: a chunk that begins after the running end of those before it opens a new island.
    """
    line = Window.partitionBy("question_id", "doc_id").orderBy("start_char", "end_char", "rank")
    before = F.max("end_char").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = chunks.withColumn("_new", F.when(F.col("start_char") <= before, 0).otherwise(1))
    islands = opened.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("question_id", "doc_id", "_island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.min("rank").alias("rank"), F.count("*").alias("n_chunks")).drop("_island")


def stitched(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans with their text, cut from the documents (doc_id, text)."""
    cut = F.substring(F.col("_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return spans.join(documents.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("text", cut).drop("_text")


def order_edges(passages: DataFrame) -> DataFrame:
    """Column ``position``: the best passages at both ends, the weakest in the middle.

    From the weakest up, passages go alternately to the front and to the back;
    the closed form of the place of rank r of n is the sign of (n - r).
    """
    ranked = passages.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))).withColumn("_i", F.count("*").over(Window.partitionBy("question_id")) - F.col("_r"))
    side = F.when(F.col("_i") % 2 == 0, -F.col("_i")).otherwise(F.col("_i"))
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy(side))).drop("_r", "_i")


def order_chronological(passages: DataFrame, stamp: Column) -> DataFrame:
    """Column ``position``: by date, those without one last, then by document and place."""
    line = Window.partitionBy("question_id").orderBy(stamp.asc_nulls_last(), "doc_id", "start_char")
    return passages.withColumn("position", F.row_number().over(line))


def within_tokens(passages: DataFrame, tokens: Column, budget: int) -> DataFrame:
    """Whole passages in rank order while they fit; the first always stays, and the first that does not fit ends the list."""
    line = Window.partitionBy("question_id").orderBy("rank")
    total = F.sum("_t").over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = passages.withColumn("_t", tokens).withColumn("_sum", total).withColumn("_n", F.row_number().over(line))
    return rows.where((F.col("_n") == 1) | (F.col("_sum") <= budget)).drop("_t", "_n").withColumnRenamed("_sum", "running_tokens")


def passage_body(text: Column, header: Column) -> Column:
    """The text between a passage's tags: the header's line, if any, and the trimmed text."""
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(header, F.lit("")) == "", body).otherwise(F.concat(header, F.lit("\n"), body))


def rendered(passages: DataFrame, position: str = "rank", header: Column | None = None) -> DataFrame:
    """question_id, passages: the numbered blocks of each question."""
    head = header if header is not None else F.lit(None).cast("string")
    rows = passages.select("question_id", F.row_number().over(Window.partitionBy("question_id").orderBy(position)).alias("i"), passage_body(F.col("text"), head).alias("body"))
    block = F.concat(F.lit('<passage id="'), F.col("i").cast("string"), F.lit('">\n'), F.col("body"), F.lit("\n</passage>"))
    listed = F.array_sort(F.collect_list(F.struct("i", block.alias("block"))))
    return rows.groupBy("question_id").agg(F.concat(F.lit("<passages>\n"), F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n"), F.lit("\n</passages>")).alias("passages"))


def prompts(questions: DataFrame, blocks: DataFrame | None, with_header: bool = False) -> DataFrame:
    """question_id, system, user.  Without ``blocks``: the closed-book prompt.  ``with_header``: some passage has a header."""
    asked = F.concat(F.lit("Question: "), F.col("question"))
    if blocks is None:
        return questions.select("question_id", F.lit(CLOSED_BOOK).alias("system"), asked.alias("user"))
    return questions.join(blocks, "question_id").select("question_id", F.lit(HEADER_SYSTEM if with_header else SYSTEM).alias("system"), F.concat("passages", F.lit("\n\n"), asked).alias("user"))


def echo_answers(passages: DataFrame) -> DataFrame:
    """question_id, answer: the first 200 characters of the first passage; the offline stand-in for a generator."""
    first = passages.groupBy("question_id").agg(F.min_by("text", "rank").alias("text"))
    return first.select("question_id", F.substring("text", 1, 200).alias("answer"))


ORDERS = ("rank", "edges", "chronological")


def with_headers(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``passages`` with the header line of their documents (doc_id and, where there are, title, source, published_at)."""
    own = lambda c: F.col(c).cast("string") if c in documents.columns else F.lit(None).cast("string")
    line = T.prompt_header(own("title"), own("source"), T.published(own("published_at")))
    return passages.drop("header").join(documents.select("doc_id", line.alias("header")), "doc_id", "left").withColumn("header", F.coalesce("header", F.lit("")))


def wrapped(chunks: DataFrame, documents: DataFrame, header: bool = False) -> DataFrame:
    """Chunks from outside a ranking (gold evidence, say) as passages: one each, in the order of ``rank``; nothing is dropped or merged."""
    rows = chunks.withColumns({"position": F.row_number().over(Window.partitionBy("question_id").orderBy("rank")), "n_chunks": F.lit(1).cast("long"), "header": F.lit("")})
    return with_headers(rows, documents) if header else rows


def assemble(chunks: DataFrame, documents: DataFrame, top_k: int, pool: int | None = None, unique: bool = True, merge: bool = True, budget: int | None = None, order: str = "rank", mmr_weight: float | None = None, vectors: DataFrame | None = None, header: bool = False, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """The whole chain, in this order: pool, dedupe, select, merge, header, budget, order.

    ``tokens`` counts a text's tokens for the budget (without it, runs of visible characters).

    ``chunks``: question_id, rank, score, chunk_id, doc_id, start_char, end_char,
    text.  ``documents``: doc_id, text, and for headers and dates title, source and
    published_at, as far as they are there.  ``mmr_weight`` with ``vectors`` (chunk_id,
    vector) selects for relevance and variety from the pool; without it the first
    ``top_k`` stay.  A passage's rank is the best of its chunks'.
    """
    if order not in ORDERS:
        raise ValueError(f"{order}: known are {', '.join(ORDERS)}")
    if pool is not None and pool < top_k:
        raise ValueError(f"a pool of {pool} is smaller than top_k, {top_k}")
    rows = chunks.where(F.col("rank") <= (pool or top_k))
    rows = dedupe(rows) if unique else rows
    if mmr_weight is not None:
        if vectors is None:
            raise ValueError("variety needs the chunks' vectors")
        scored = rows.withColumn("relevance", min_max(F.col("score"), "question_id"))
        own = scored.join(vectors.select("chunk_id", dense.unit(F.col("vector")).alias("vector")), "chunk_id").select("question_id", "chunk_id", "rank", "relevance", "vector")
        rows = rows.join(mmr(own, "chunk_id", top_k, mmr_weight).select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi")
    else:
        place = F.row_number().over(Window.partitionBy("question_id").orderBy("rank"))
        rows = rows.withColumn("_place", place).where(F.col("_place") <= top_k).drop("_place")
    rows = stitched(merge_neighbours(rows), documents) if merge else rows.withColumn("n_chunks", F.lit(1).cast("long"))
    rows = with_headers(rows, documents) if header else rows.withColumn("header", F.lit(""))
    if budget is not None:
        rows = within_tokens(rows, (tokens or token_count)(passage_body(F.col("text"), F.col("header"))), budget)
    if order == "edges":
        return order_edges(rows)
    if order == "chronological":
        stamp = T.published(F.col("_published").cast("string"))
        dated = documents.select("doc_id", (F.col("published_at") if "published_at" in documents.columns else F.lit(None)).cast("string").alias("_published"))
        return order_chronological(rows.join(dated, "doc_id", "left"), stamp).drop("_published")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))


def contents(passages: DataFrame, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """question_id, context_passages, context_chunks, context_tokens of assembled passages, as they are rendered."""
    own = passages.groupBy("question_id").agg(F.count("*").alias("context_passages"), F.sum("n_chunks").alias("context_chunks"))
    blocks = rendered(passages, "position", F.col("header"))
    return own.join(blocks.select("question_id", (tokens or token_count)(F.col("passages")).cast("long").alias("context_tokens")), "question_id")


def token_count(text: Column) -> Column:
    """Runs of characters that are not white space: the default tokenizer."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def counter(ranks_path: str, pattern: str) -> Callable[[Column], Column]:
    """A token count by a public rank file, as a column function; the encoder is loaded once per worker."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t or "")))

    return count
