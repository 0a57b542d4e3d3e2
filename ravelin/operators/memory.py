"""Conversation memory over (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_exchanges(turns: DataFrame, k: int = 2) -> DataFrame:
    """Turns of each conversation's last k exchanges; an exchange is a user turn with its replies."""
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("exchange").over(Window.partitionBy("conv_id"))
    return turns.withColumn("exchange", n).withColumn("last", last).where((F.col("exchange") > 0) & (F.col("exchange") > F.col("last") - k)).drop("last")


def within_budget(turns: DataFrame, budget: int, tokens: Column) -> DataFrame:
    """The latest turns of each conversation whose tokens together stay within the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)
