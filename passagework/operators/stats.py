"""Agreement, differences and cluster-bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, agree, kappa of two boolean columns in one pass; 1 where chance agreement is certain."""
    x, y = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    one = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agree"), x.alias("x"), y.alias("y"))
    chance = F.col("x") * F.col("y") + (1 - F.col("x")) * (1 - F.col("y"))
    return one.withColumn("chance", chance).select("n", "agree", F.when(F.col("chance") >= 1, 1.0).otherwise(F.try_divide(F.col("agree") - F.col("chance"), 1 - F.col("chance"))).alias("kappa"))


def confusion(pairs: DataFrame, judge: str, human: str) -> DataFrame:
    """n, agree, too_kind (judge yes, human no), too_harsh."""
    j, h = F.col(judge), F.col(human)
    return pairs.where(j.isNotNull() & h.isNotNull()).agg(F.count("*").alias("n"), F.count_if(j == h).alias("agree"), F.count_if(j & ~h).alias("too_kind"), F.count_if(~j & h).alias("too_harsh"))


def separation(ranked: DataFrame, group: str, rank: str, relevant: str) -> DataFrame:
    """group, auc: chance that a relevant row ranks above another; null where one class is empty.  From rank sums, without pairs.

    Rows are dealt by ranges of group and rank, so a large group is many parts;
    ranks are counted within a part, and a part's place adds those before it.
    """
    parts = ranked.select(group, rank, F.coalesce(F.col(relevant), F.lit(False)).alias("_r")).repartitionByRange(group, rank).withColumn("_p", F.spark_partition_id())
    rows = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_p", group).orderBy(rank)))
    own = rows.groupBy("_p", group).agg(F.count("*").alias("n"), F.count_if("_r").alias("pos"), F.coalesce(F.sum(F.when(F.col("_r"), F.col("_n"))), F.lit(0)).alias("ranks"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = own.withColumn("ranks", F.col("ranks") + F.col("pos") * before).groupBy(group).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("ranks").alias("ranks"))
    neg = F.col("n") - F.col("pos")
    worse = F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2
    return total.select(group, F.when((F.col("pos") > 0) & (neg > 0), 1 - worse / (F.col("pos") * neg)).alias("auc"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """question_id, metric, a, b where both runs (question_id, metric, value) have the metric."""
    both = a.select("question_id", "metric", F.col("value").alias("a")).join(b.select("question_id", "metric", F.col("value").alias("b")), ["question_id", "metric"])
    return both.where("a is not null and b is not null")


def flips(pairs: DataFrame) -> DataFrame:
    """metric, differing, shared, mean_difference."""
    return pairs.groupBy("metric").agg(F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("differing"), F.count("*").alias("shared"), F.avg(F.col("a") - F.col("b")).alias("mean_difference"))


def winners(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """metric (and ``by``), winner (a, b or tie), questions."""
    gap = F.col("a") - F.col("b")
    group = ["metric", *([by] if by else []), "winner"]
    return pairs.withColumn("winner", F.when(gap > 1e-9, "a").when(gap < -1e-9, "b").otherwise("tie")).groupBy(*group).agg(F.count("*").alias("questions"))


def resampled(sums: np.ndarray, counts: np.ndarray, samples: int, seed: int, level: float) -> tuple[float, float, float, int]:
    """Mean, low, high, n, drawing whole clusters; NaN without rows."""
    n = int(counts.sum())
    if not n:
        return float("nan"), float("nan"), float("nan"), 0
    rng = np.random.default_rng(seed)
    means = np.empty(samples)
    for k in range(0, samples, 256):  # blocks, so that memory follows the clusters and not their product with the samples
        draw = rng.integers(0, len(sums), size=(min(256, samples - k), len(sums)))
        means[k : k + len(draw)] = sums[draw].sum(1) / counts[draw].sum(1)
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(sums.sum() / n), float(low), float(high), n


def bootstrap(rows: DataFrame, group: list[str], cluster: str, value: str, samples: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """group, mean, low, high, n.  Clusters are summed by Spark first, so a task sees one row per cluster."""
    reduced = rows.where(F.col(value).isNotNull()).groupBy(*group, cluster).agg(F.sum(value).cast("double").alias("_s"), F.count("*").alias("_c"))
    kinds = dict(rows.dtypes)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster)
        mean, low, high, n = resampled(pdf["_s"].to_numpy(float), pdf["_c"].to_numpy(float), samples, seed, level)
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, "mean": mean, "low": low, "high": high, "n": n}])

    return reduced.groupBy(*group).applyInPandas(draw, ", ".join(f"{g} {kinds[g]}" for g in group) + ", mean double, low double, high double, n long")


def paired_bootstrap(pairs: DataFrame, clusters: DataFrame, cluster: str, **settings) -> DataFrame:
    """metric, mean, low, high, n of a - b, over whole clusters (question_id, cluster)."""
    rows = pairs.join(clusters, "question_id").withColumn("difference", F.col("a") - F.col("b"))
    return bootstrap(rows, ["metric"], cluster, "difference", **settings)
