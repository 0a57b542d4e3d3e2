"""Joins, set operations, splits and aggregates of the evaluation workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semi(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def remaining(tasks: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Tasks not finished yet; ``on`` names question and model, so models don't share progress."""
    return tasks.join(done.select(*on), on, "left_anti")


def missing_per_group(rows: DataFrame, known: DataFrame, on: str, group: str) -> DataFrame:
    return rows.join(known, on, "left_anti").groupBy(group).agg(F.count("*").alias("missing"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty for equal multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """``df``; reading it fails if a key comes twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{key} is not unique")).cast("boolean")).otherwise(True)).drop("__n")


def answers_wide(answers: DataFrame, models: list[str], question: str = "question", model: str = "model", answer: str = "answer") -> DataFrame:
    """One row a question, one column a model."""
    return answers.groupBy(question).pivot(model, models).agg(F.min(answer))


def answers_long(wide: DataFrame, models: list[str], question: str = "question") -> DataFrame:
    return wide.unpivot(question, models, "model", "answer")


def distinct_in_order(df: DataFrame, column: str, position: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(position).alias("first_position"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def positional_split(df: DataFrame, ratio: float, order: list[str]) -> DataFrame:
    """``part`` train for the first floor(n * ratio) rows, else test, and the position.

    The position is a count within ranges of the first order column plus the counts of the ranges
    before, so no single task sorts all rows.
    """
    cuts = df.select(F.percentile_approx(order[0], [k / 16 for k in range(1, 16)], 10_000)).first()[0] or []
    bucket = sum((F.when(F.col(order[0]) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    rows = df.withColumn("__b", bucket)
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    # at most 16 rows
    base = counts.select(F.col("__b"), F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy(*order)) + F.col("__base")
    out = rows.join(F.broadcast(base), "__b").withColumn("position", place)
    return out.withColumn("part", F.when(F.col("position") <= F.floor(F.col("__all") * ratio), "train").otherwise("test")).drop("__b", "__base", "__all")


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least hash: the same rows on every run."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def looked_up(df: DataFrame, codes: DataFrame, key: str, default: str) -> DataFrame:
    """``df`` with the ``label`` of a table of codes (key, label), a default where it has none. Spark broadcasts codes that are small by their size and shuffles others; none is left out."""
    return df.join(codes, key, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def concatenated(df: DataFrame, by: list[str], order: str, text: Column, separator: str = "\n\n") -> DataFrame:
    """Texts of each group joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: p["t"]), separator).alias("text"))
