"""Joining ranked lists.  A list is question_id, list_no, key, rank, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_seen() -> Column:
    """Where a chunk was seen first: earlier list, then earlier rank."""
    return F.min(F.struct("list_no", "rank"))


def _ranked(fused: DataFrame, key: str, k: int | None, decimals: int = 12) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", decimals)), "seen")
    out = fused.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).select("question_id", key, "score", "rank")


def reciprocal_rank(lists: DataFrame, key: str, k: float = 60.0, weights: dict[int, float] | None = None, top: int | None = None) -> DataFrame:
    """Sum of weight / (k + rank)."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, float(w))])[F.col("list_no")], F.lit(1.0)) if weights else F.lit(1.0)
    return _ranked(lists.groupBy("question_id", key).agg(F.sum(weight / (k + F.col("rank"))).alias("score"), _first_seen().alias("seen")), key, top)


def normalised(lists: DataFrame, method: str = "minmax") -> DataFrame:
    """Scores of each list brought to a common scale; a list of equal scores gets 0."""
    own = Window.partitionBy("question_id", "list_no")
    if method == "minmax":
        shift, spread = F.min("score").over(own), F.max("score").over(own) - F.min("score").over(own)
    elif method == "zscore":
        shift, spread = F.avg("score").over(own), F.stddev_pop("score").over(own)
    else:
        raise ValueError(f"unknown method {method}; there are minmax and zscore")
    rows = lists.withColumns({"shift": shift, "spread": spread})
    return rows.withColumn("norm", F.when(F.col("spread") > 0, (F.col("score") - F.col("shift")) / F.col("spread")).otherwise(0.0)).drop("shift", "spread")


def weighted(lists: DataFrame, key: str, weights: dict[int, float], method: str = "minmax", top: int | None = None) -> DataFrame:
    """Weighted sum of normalised scores; a chunk that a list lacks gets that list's lowest, an empty list gives 0.

    sum(w * norm) over the lists that have the chunk, plus the floors of all
    lists of the question, less the floors of those lists.
    """
    weight = F.create_map(*[F.lit(x) for n, w in weights.items() for x in (n, float(w))])[F.col("list_no")]
    rows = normalised(lists, method).withColumn("w", weight)
    floors = rows.groupBy("question_id", "list_no").agg(F.min(F.col("norm") * F.col("w")).alias("floor"))
    total = floors.groupBy("question_id").agg(F.sum("floor").alias("floors"))
    own = rows.join(floors, ["question_id", "list_no"])
    fused = own.groupBy("question_id", key).agg(F.sum(F.col("norm") * F.col("w") - F.col("floor")).alias("gain"), _first_seen().alias("seen"))
    return _ranked(fused.join(total, "question_id").withColumn("score", F.col("gain") + F.col("floors")), key, top, 9)


def weight_grid(lists: DataFrame, key: str, shares: list[float], methods: tuple[str, ...] = ("minmax", "zscore"), top: int | None = None) -> DataFrame:
    """method, share (of list 0; list 1 has the rest), question_id, key, score, rank: every setting of weighted fusion over the same lists."""
    out = None
    for method in methods:
        for share in shares:
            rows = weighted(lists, key, {0: share, 1: 1 - share}, method, top).withColumns({"method": F.lit(method), "share": F.lit(float(share))})
            out = rows if out is None else out.unionByName(rows)
    return out.select("method", "share", "question_id", key, "score", "rank")


def constant_grid(lists: DataFrame, key: str, constants: list[float], top: int | None = None) -> DataFrame:
    """k, question_id, key, score, rank: reciprocal rank fusion with each constant, in one pass over the lists."""
    grid = lists.sparkSession.createDataFrame([(float(k),) for k in constants], "k double")
    rows = lists.crossJoin(F.broadcast(grid))  # a handful of literal rows
    fused = rows.groupBy("k", "question_id", key).agg(F.sum(1.0 / (F.col("k") + F.col("rank"))).alias("score"), _first_seen().alias("seen"))
    order = Window.partitionBy("k", "question_id").orderBy(F.desc(F.round("score", 12)), "seen")
    out = fused.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= top) if top else out).select("k", "question_id", key, "score", "rank")


def round_robin(lists: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Lists interleaved by position, then list; the first occurrence counts; score 1 / rank."""
    first = lists.groupBy("question_id", key).agg(F.min(F.struct("rank", "list_no")).alias("seen"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("seen")))
    out = out.where(F.col("rank") <= top) if top else out
    return out.select("question_id", key, (1.0 / F.col("rank")).alias("score"), "rank")


def collapse(ranked: DataFrame, span: list[str]) -> DataFrame:
    """The best row of each span of a question, ranked anew."""
    best = Window.partitionBy("question_id", *span).orderBy("rank")
    kept = ranked.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("rank")))
