"""An inverted index with block maxima, and BM25 search of many queries over it.

A block is a term's documents in one range of ids, with the greatest impact (the BM25 part that doesn't depend on the query) among them;
ranges are the same for all terms, so the sum of a query's block maxima bounds every score in a range. A query first reads the ranges with
the greatest bounds; the k-th score found there is a floor, and ranges whose bound stays below it are never read.

Texts are shuffled once, by range, and a range's postings are made and written where its texts are. A search shuffles the blocks of the
terms asked for, by range again, so a document's score is whole in one task and only each task's k best of a query leave it.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.text import tokens
from ravelin.operators.retrieval import K1, B

#: Ids of one range, and ranges that a query reads before it has a floor.
RANGE, FIRST = 64, 4
#: Words of texts, and pairs of a query and a range, that a task takes.
WORDS, PAIRS = 1_000_000, 4096
#: Most rows of queries' terms, or of ranges, that are sent to all executors.
SENT = 1_000_000
#: More than rounding scores to six places can move them.
SLACK = 2e-6


def _shares(df: DataFrame, least: float) -> int:
    """Into how many parts to deal: two at least, as one alone is dealt anew for a join."""
    return max(ceil(least), df.sparkSession.sparkContext.defaultParallelism, 2)


def build(docs: DataFrame, path: str, width: int = RANGE, k1: float = K1, b: float = B, id_col: str = "doc_id") -> None:
    """Write the index of (id, text) below ``path``: ``blocks`` (term, range, top, postings), whole ranges in a file and sorted by term there, and ``terms`` (term, df, idf). Null texts count as documents but not for the mean length, as in bm25()."""
    lens = docs.select(F.size(tokens(F.col("text"))).alias("len"))
    n, avg_len, words = lens.agg(F.count("*"), F.avg("len"), F.coalesce(F.sum("len"), F.lit(0))).first()
    doc_id = F.col(id_col).cast("long")
    # rows without id share the first range
    texts = docs.select(F.coalesce(F.floor(doc_id / width), F.lit(0)).alias("range"), doc_id.alias("doc_id"), "text").repartition(_shares(docs, words / WORDS), "range")
    toks = texts.select("range", "doc_id", tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    # explode() would split texts before the shuffle as well, to leave those without words out; both groupings hold the range and stay in its task
    tf = toks.select("range", "doc_id", "len", F.explode_outer("t").alias("term")).where(F.col("term").isNotNull()).groupBy("range", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len or 1.0)))
    one = tf.select("term", "range", F.struct("doc_id", impact.alias("impact")).alias("p"))
    blocks = one.groupBy("term", "range").agg(F.max("p.impact").alias("top"), F.sort_array(F.collect_list("p")).alias("postings"))
    blocks.sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{path}/blocks")
    held = docs.sparkSession.read.parquet(f"{path}/blocks")
    df = held.groupBy("term").agg(F.sum(F.size("postings")).alias("df"))
    df.select("term", "df", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.mode("overwrite").parquet(f"{path}/terms")


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, doc_id, score) of each query with their rank; ties by smaller id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


class Index:
    """A written index. ``queries`` are rows (query_id, text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.blocks = spark.read.parquet(f"{path}/blocks")
        self.terms = spark.read.parquet(f"{path}/terms")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, idf) of each query's distinct terms that the index holds."""
        return queries.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term")).distinct().join(self.terms.select("term", "idf"), "term")

    def bounds(self, asked: DataFrame) -> DataFrame:
        """(query_id, range, bound): no document of the range scores more; reads block maxima and no posting."""
        return asked.join(self.blocks.select("term", "range", "top"), "term").groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))

    def scored(self, asked: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score) of each query's k best matches in its ranges (query_id, range)."""
        pairs = ranges.count()
        dealt = lambda df: df.repartition(_shares(asked, pairs / PAIRS), "range")
        few = asked.count() <= SENT
        wanted = dealt(ranges).join(F.broadcast(asked), "query_id") if few else dealt(ranges.join(asked, "query_id"))
        held = self.blocks.select("term", "range", "postings").join(asked.select("term").distinct(), "term", "left_semi")
        if pairs <= SENT:
            held = held.join(F.broadcast(ranges.select("range").distinct()), "range", "left_semi")
        types = {f.name: f.dataType.simpleString() for f in asked.schema}

        def best(wanted: pa.Table, held: pa.Table) -> pa.Table:
            """The k best documents of one range for each query that reads it."""
            lists = held["postings"].combine_chunks()
            doc_ids, impacts = lists.values.field("doc_id"), lists.values.field("impact").to_numpy(zero_copy_only=False)
            starts, sizes = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
            at = pc.index_in(wanted["term"], value_set=held["term"].combine_chunks()).combine_chunks()
            asks = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            block = at.take(pa.array(asks)).to_numpy(zero_copy_only=False).astype(np.int64)
            n = sizes[block].astype(np.int64)
            # places of all postings that are asked for, one ask after the other
            place = np.repeat(starts[block] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids, queries = pc.unique(doc_ids), pc.unique(wanted["query_id"])
            ids = ids.take(pc.sort_indices(ids))
            across = max(len(ids), 1)
            doc = pc.index_in(doc_ids, value_set=ids).to_numpy(zero_copy_only=False)[place]
            query = pc.index_in(wanted["query_id"], value_set=queries).to_numpy()[asks]
            cell = np.repeat(query.astype(np.int64) * across, n) + doc
            sums = np.bincount(cell, np.repeat(wanted["idf"].to_numpy()[asks], n) * impacts[place])
            found = np.unique(cell)
            score = np.round(sums[found], 6)
            order = np.lexsort((found % across, -score, found // across))
            found, score = found[order], score[order]
            q, d = np.divmod(found, across)
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            return pa.table({"query_id": queries.take(pa.array(q[kept])), "doc_id": ids.take(pa.array(d[kept])), "score": pa.array(score[kept], pa.float64())})

        scores = wanted.groupBy("range").cogroup(dealt(held).groupBy("range")).applyInArrow(best, f"query_id {types['query_id']}, doc_id long, score double")
        return _best(scores, k).drop("rank")

    def search(self, queries: DataFrame, k: int, folder: str, first: int = FIRST) -> DataFrame:
        """query_id, doc_id, score and rank of each query's k best documents that hold one of its terms; ties by smaller id. What was read is left in ``folder``/read."""
        spark = queries.sparkSession

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        asked = kept(self.asked(queries), "asked")
        bounds = kept(self.bounds(asked), "bounds")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        begun = kept(bounds.withColumn("place", place).where(F.col("place") <= first).select("query_id", "range"), "first")
        early = kept(self.scored(asked, begun, k), "early")
        floor = _best(early, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        late = bounds.join(begun, ["query_id", "range"], "left_anti").join(floor, "query_id", "left")
        late = kept(late.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).select("query_id", "range"), "late")
        kept(begun.union(late), "read")
        return _best(early.union(self.scored(asked, late, k)), k)

    def postings_read(self, folder: str) -> tuple[int, int]:
        """Postings that the last search in ``folder`` read, and those that its terms hold in all."""
        spark = self.blocks.sparkSession
        asked, read = (spark.read.parquet(f"{folder}/{x}") for x in ("asked", "read"))
        sizes = asked.join(self.blocks.select("term", "range", F.size("postings").alias("n")), "term")
        total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        return total(sizes.join(read, ["query_id", "range"], "left_semi")), total(sizes)
