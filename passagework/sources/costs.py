"""What model calls cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import append_ledger


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with cost; prices (model, input, output) are per million tokens, an unknown model costs nothing."""
    cost = (F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1e6
    return usage.join(prices, "model", "left").withColumn("cost", F.coalesce(cost, F.lit(0.0))).drop("input", "output")


def bill(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """model, calls, input_tokens, output_tokens, cost of the calls that no cache answered; tokens are summed before prices are joined."""
    own = usage.where("not cached").groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return priced(own, prices)


def flush(usage: DataFrame, prices: DataFrame, path: str, step: str) -> DataFrame:
    """Append what ``usage`` cost to the ledger, a row per model, and return the rows.

    The totals are those of the rows that are given, so a caller that begins anew
    with each step counts nothing twice, whatever was retried.
    """
    rows = bill(usage, prices).select(F.current_timestamp().alias("time"), F.lit(step).alias("step"), "model", "input_tokens", "output_tokens", F.col("cost").alias("cost_usd"))
    spent = rows.where("input_tokens + output_tokens > 0")
    append_ledger(spent, path)
    return spent
