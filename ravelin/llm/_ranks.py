"""Positions and sums over a whole table in a given order, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm._store import saved


def running(rows: DataFrame, order: list[str], folder: str, name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``pos``, the number of rows before in that order, and ``before_<column>``, the sum of a long column over them.

    Rows are dealt by ranges of the order, which must tell all rows apart; a task counts on from the rows before in its range, and the
    ranges' totals, one row a partition, are summed and sent to all.
    """
    made = ["pos", *(f"before_{c}" for c in sums)]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.zeros(len(made), np.int64)
        for batch in batches:
            each = [np.ones(batch.num_rows, np.int64), *(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in sums)]
            upto = [np.concatenate([[n], n + np.cumsum(x)]) for n, x in zip(at, each)]
            at = np.array([x[-1] for x in upto])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x[:-1]) for x in upto)], names=[*batch.schema.names, *made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    local = saved(dealt.mapInArrow(run, fields + "".join(f", {m} long" for m in made)), folder, name)
    totals = local.groupBy("part").agg(F.count("*").alias("pos"), *[F.sum(c).alias(f"before_{c}") for c in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"off_{m}") for m in made])
    return local.join(F.broadcast(offsets), "part").select(*rows.columns, *[(F.col(m) + F.col(f"off_{m}")).alias(m) for m in made])
