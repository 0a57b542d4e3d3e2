"""Ranking: BM25, cosine similarity, rank fusion and diversity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.text import tokens
from ravelin.functions.vector import dot, doubles, unit

#: Our choice of the constants that only libraries know.
K1, B, RRF = 1.5, 0.75, 60
#: Most query rows that are sent to all executors at a time.
BROADCAST_QUERIES = 10_000


def bm25(docs: DataFrame, query: list[str], k1: float = K1, b: float = B, id_col: str = "doc_id") -> DataFrame:
    """doc_id and BM25 score of the documents that hold a query term.

    Only query terms are exploded, so the shuffle carries matches and not the corpus.
    """
    terms = sorted(set(query))
    toks = docs.select(id_col, tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    totals = toks.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = toks.select(id_col, "len", F.explode(F.filter("t", lambda x: x.isin(terms))).alias("term")).groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # one row of totals and one a query term
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    return scored.groupBy(id_col).agg(F.round(F.sum(part), 6).alias("score"))


def top(df: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def cosine(vectors: DataFrame, query: list[float], id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    q = np.array(query, float)
    q = (q / (np.linalg.norm(q) or 1)).tolist()
    return vectors.select(id_col, F.round(dot(unit(doubles(F.col(column))), F.lit(q)), 6).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Exact k nearest of each query by cosine: query_id, vec_id, score, rank. Itself is left out.

    Queries are walked in blocks of at most ``BROADCAST_QUERIES`` rows. For each block, each partition
    keeps its own k best of every query by matrix products, so what is shuffled is k rows a query and
    partition. The driver takes the query rows a partition at a time and holds their vectors.
    """
    found = queries.select(F.col(id_col).alias("q"), doubles(F.col(column)).alias("v")).toLocalIterator()
    blocks = [(np.array([r.q for r in rows], np.int64), np.array([r.v for r in rows], float)) for rows in batched(found, BROADCAST_QUERIES)]
    none = (np.empty(0, np.int64), np.empty(0))
    near = reduce(DataFrame.unionByName, [_near(vectors, *block, k, id_col, column) for block in blocks or [none]])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _near(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, id_col: str, column: str) -> DataFrame:
    """query_id, vec_id and score of what may be among the k nearest of a block of queries."""
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(q) else q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                own = np.array(part.column(0).to_pylist(), np.int64)
                v = np.array(part.column(1).to_pylist(), float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                for a in range(0, len(ids), 512):
                    s = np.round(q[a : a + 512] @ v.T, 6)
                    s[ids[a : a + 512, None] == own[None, :]] = -np.inf
                    keep = min(k, s.shape[1])
                    # ties at the edge are kept whole
                    edge = -np.partition(-s, keep - 1, axis=1)[:, keep - 1]
                    x, y = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + x]), pa.array(own[y]), pa.array(s[x, y])], names=["query_id", id_col, "score"])

    return vectors.select(F.col(id_col), doubles(F.col(column)).alias("v")).mapInArrow(run, f"query_id long, {id_col} long, score double")


def fuse(rankings: list[tuple[DataFrame, float]], id_col: str = "doc_id", c: int = RRF) -> DataFrame:
    """Weighted reciprocal-rank fusion of (id, rank) lists: id, score."""
    parts = [df.select(id_col, (F.lit(w) / (c + F.col("rank"))).alias("s")) for df, w in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_col).agg(F.round(F.sum("s"), 8).alias("score"))


def ranked(df: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best rows with their rank; the sort is of k rows."""
    return top(df, k, tie=id_col).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def mmr(candidates: DataFrame, k: int, balance: float = 0.5, id_col: str = "vec_id") -> DataFrame:
    """Max-marginal-relevance order of each query's candidates (query_id, id, score, embedding): query_id, id, rank. With balance 1 it is the order by score."""

    def pick(t: pa.Table) -> pa.Table:
        ids, rel = np.array(t[id_col].to_pylist()), np.array(t["score"].to_pylist(), float)
        v = np.array(t["embedding"].to_pylist(), float)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        order = np.lexsort((ids, -rel))
        ids, rel, v = ids[order], rel[order], v[order]
        chosen: list[int] = []
        closest = np.full(len(ids), -np.inf)
        for _ in range(min(k, len(ids))):
            gain = balance * rel - (1 - balance) * np.where(np.isinf(closest), 0, closest)
            gain[chosen] = -np.inf
            best = int(np.argmax(np.round(gain, 9)))
            chosen.append(best)
            closest = np.maximum(closest, v @ v[best])
        return pa.table({"query_id": pa.array([t["query_id"][0].as_py()] * len(chosen), pa.int64()), id_col: pa.array(ids[chosen], pa.int64()), "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    return candidates.select("query_id", id_col, "score", "embedding").groupBy("query_id").applyInArrow(pick, f"query_id long, {id_col} long, rank int")
