"""Batches of a stream that take effect exactly once, without keys, and what was counted while they were written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "run string, batch long, counted map<string,long>"


def log(spark: SparkSession, path: str) -> DataFrame:
    """(run, batch, counted) of every committed batch."""
    try:
        return spark.read.schema(LOG).option("recursiveFileLookup", True).parquet(f"{path}/log")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], LOG)
        raise


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of the committed batches, with run and batch; None before the first. What a lost batch left behind is not read."""
    done = log(spark, path)
    if done.isEmpty():
        return None
    rows = spark.read.option("mergeSchema", True).parquet(f"{path}/rows")
    rows = rows.withColumn("run", F.col("run").cast("string")).withColumn("batch", F.col("batch").cast("long"))
    return rows.join(done.select("run", "batch"), ["run", "batch"], "left_semi")


def _commit(spark: SparkSession, path: str, run: str, batch: int, counted: dict[str, int]) -> None:
    """One file under the batch's own name: it is there whole or not at all."""
    row = spark.createDataFrame([(run, batch, counted)], LOG).coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/log/{run}-{batch}")


def write(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, counters: dict[str, Column] | None = None):
    """Work through a stream's batches until its input is used up; every batch's rows are at ``path`` once, whenever the driver is lost.

    A batch is written to a folder of its run and number and then logged with its counters (sums of integer columns of the worked rows), which
    are observed in the write itself and need no second pass. A batch that is replayed after it was logged adds nothing and isn't worked again;
    one that was lost before is written over. Rows may repeat and need no key. A run is what has one checkpoint: with a new one the input counts as new.
    Counters over no rows are 0.
    """
    counters = counters or {}

    def one(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        run = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()[0]
        if not log(spark, path).where((F.col("run") == run) & (F.col("batch") == batch)).isEmpty():
            return
        seen = Observation()
        rows = work(df).observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in counters.items()])
        rows.write.mode("overwrite").parquet(f"{path}/rows/run={run}/batch={batch}")
        _commit(spark, path, run, batch, seen.get)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
