"""Correctness of answers by their claims: sentences of an answer aligned one to one with those of its reference."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import tokens
from ravelin.operators.evaluation import f1

#: Pairs whose claims a task's Python holds at a time.
ROWS = 64


def sentences(text: Column) -> Column:
    return F.split(text, r"[.!?\n]+")


def claims(text: Column) -> Column:
    """The claims of a text, each its distinct words in order. Sentences without words, and null texts, make none."""
    made = F.transform(sentences(text), lambda s: F.array_join(F.array_sort(F.array_distinct(tokens(s))), " "))
    return F.coalesce(F.filter(made, lambda c: c != ""), F.array().cast("array<string>"))


def alike(a: list[str], b: list[str], percent: int) -> list[tuple[int, int, int, int]]:
    """(place in a, place in b, both, either): claims, one of each side, whose words overlap by ``percent`` of their union or more.

    The longest words of a claim come first, as they tend to be rare; two claims that overlap so share one of their first ``size - ceil(percent of size) + 1``,
    in whatever order. Only claims that meet on those words are compared.
    """
    words = [[set(c.split(" ")) for c in side] for side in (a, b)]
    first = lambda w: sorted(w, key=lambda x: (-len(x), x))[: len(w) + (-len(w) * percent // 100) + 1]
    where: dict[str, list[int]] = {}
    for j, w in enumerate(words[1]):
        for x in first(w):
            where.setdefault(x, []).append(j)
    out = []
    for i, w in enumerate(words[0]):
        for j in sorted({j for x in first(w) for j in where.get(x, ())}):
            y = words[1][j]
            if len(w) * percent <= 100 * len(y) and len(y) * percent <= 100 * len(w):
                both = len(w & y)
                if both * 100 >= (len(w) + len(y) - both) * percent:
                    out.append((i, j, both, len(w) + len(y) - both))
    return out


_COMPARED = pa.schema([("made", pa.int64()), ("wanted", pa.int64()), ("same", pa.int64()), ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("alike", pa.float64())])))])


def compared(sides: DataFrame, percent: int) -> DataFrame:
    """id, made, wanted, same and links of (id, a, b), the claims of both sides: how many each makes, how many of them are equal, and the links between those left over, by their places in order.

    An id's claims are in its row, so they are compared where the row is and nothing of them is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(k, ROWS), []
                for x, y in zip(part.column(1), part.column(2)):
                    a, b = Counter(x.as_py()), Counter(y.as_py())
                    # equal claims are the most alike, so they are taken first, by counting; only what is left over is compared
                    left, right = (sorted(z) for z in (a - b, b - a))
                    links = [{"a": i, "b": j, "n_a": a[left[i]] - b[left[i]], "n_b": b[right[j]] - a[right[j]], "alike": both / either} for i, j, both, either in alike(left, right, percent)]
                    rows.append({"made": a.total(), "wanted": b.total(), "same": (a & b).total(), "links": links})
                yield pa.RecordBatch.from_arrays([part.column(0), *pa.RecordBatch.from_pylist(rows, _COMPARED).columns], names=["id", *_COMPARED.names])

    kind = sides.schema["id"].dataType.simpleString()
    return sides.select("id", "a", "b").mapInArrow(run, f"id {kind}, made long, wanted long, same long, links array<struct<a: int, b: int, n_a: long, n_b: long, alike: double>>")


def matched(links: DataFrame, folder: str) -> DataFrame:
    """(id, tp): how many claims the greedy one-to-one matching of links (id, a, b, n_a, n_b, alike) pairs, the most alike first, ties by the place of a, then of b.

    A claim made n times has n places. In each round every link that is the best left of both its claims is taken, which is what
    taking them one by one in order gives; rounds are written to ``folder`` and end when no link is left.
    """
    spark, k = links.sparkSession, 0
    links.withColumn("now", F.lit(0).cast("long")).write.parquet(f"{folder}/round-0")
    of = lambda side: Window.partitionBy("id", side)
    while True:
        left = spark.read.parquet(f"{folder}/round-{k}").where("n_a > 0 and n_b > 0")
        if left.isEmpty():
            break
        # dealt by id once, which serves both sides' windows
        rows = left.repartition("id")
        for side in ("a", "b"):
            rows = rows.withColumn(f"by_{side}", F.row_number().over(of(side).orderBy(F.desc("alike"), "a", "b")))
        rows = rows.withColumn("now", F.when((F.col("by_a") == 1) & (F.col("by_b") == 1), F.least("n_a", "n_b")).otherwise(0)).drop("by_a", "by_b")
        for side in ("a", "b"):
            rows = rows.withColumn(f"n_{side}", F.col(f"n_{side}") - F.sum("now").over(of(side)))
        k += 1
        rows.write.parquet(f"{folder}/round-{k}")
    rounds = [spark.read.parquet(f"{folder}/round-{x}").where("now > 0").select("id", "now") for x in range(k + 1)]
    return reduce(DataFrame.union, rounds).groupBy("id").agg(F.sum("now").alias("tp"))


def correctness(pairs: DataFrame, folder: str, percent: int = 50) -> DataFrame:
    """id, tp, fp, fn, f1 of (id, answer, reference): claims of the answer that the reference makes, that it doesn't, and those of the reference that the answer leaves out.

    Two claims are one where their words overlap by ``percent`` of their union, which stands in for a judge. Rows of one id are one pair, whose figures each has;
    a row without id has none. A pair without claims on either side has f1 0.
    """
    sides = pairs.select("id", claims(F.col("answer")).alias("a"), claims(F.col("reference")).alias("b"))
    again = pairs.groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    if again:
        sides = sides.where("id is not null").groupBy("id").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))
    compared(sides, percent).write.parquet(f"{folder}/compared")
    held = pairs.sparkSession.read.parquet(f"{folder}/compared")
    links = held.select("id", F.explode("links").alias("l")).select("id", "l.*")
    rows = held.drop("links").join(matched(links, folder), "id", "left")
    rows = (pairs.select("id").join(rows, "id", "left") if again else rows).fillna(0, ["made", "wanted", "same", "tp"])
    rows = rows.withColumn("tp", F.col("tp") + F.col("same"))
    rows = rows.select("id", "tp", (F.col("made") - F.col("tp")).alias("fp"), (F.col("wanted") - F.col("tp")).alias("fn"))
    return rows.withColumn("f1", F.round(f1(F.col("tp"), F.col("fp"), F.col("fn")), 6))
