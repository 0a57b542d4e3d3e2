"""Scores of answers and rankings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs whose scores a task's Python holds at a time; their texts are taken apart one pair after another.
ROWS = 1024


def leaderboard(scores: DataFrame, baseline: str, mixtures: tuple[str, ...] = ()) -> DataFrame:
    """combined, differences in percent from the baseline row and the ratio of both scores, best first. Models whose name
    begins with one of ``mixtures`` have no scores per billion parameters, as all of theirs don't work on an answer."""
    dense = ~F.greatest(F.lit(False), *[F.col("model").startswith(m) for m in mixtures], F.lit(False))
    base = scores.where(F.col("model") == baseline).select(F.col("faithfulness").alias("bf"), F.col("factual").alias("bc"))
    diff = lambda a, b: F.round((F.col(a) - F.col(b)) / F.col(b) * 100, 4)
    return scores.crossJoin(F.broadcast(base.limit(1))).select(
        "model", F.round((F.col("faithfulness") + F.col("factual")) / 2, 6).alias("combined"), diff("faithfulness", "bf").alias("faith_diff"), diff("factual", "bc").alias("fact_diff"),
        F.round(F.col("faithfulness") / F.col("factual"), 6).alias("ratio"), F.when(dense, F.round(F.col("faithfulness") / F.col("params"), 6)).alias("faith_per_b"), F.when(dense, F.round(F.col("factual") / F.col("params"), 6)).alias("fact_per_b"),
    ).orderBy(F.desc("combined"))


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int, id_col: str) -> DataFrame:
    """precision, recall and reciprocal rank at k of each query: ranked (query_id, id, rank), relevant (query_id, id)."""
    hit = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", id_col], "left")
    per = hit.groupBy("query_id").agg(F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    total = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    return per.join(total, "query_id", "left").select(
        "query_id", F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr")
    )


def eval_record(rows: DataFrame, question: str, answer: str, context: str, reference: str) -> DataFrame:
    """The record an evaluator takes; the one context becomes a list."""
    return rows.select("id", F.col(question).alias("user_input"), F.col(answer).alias("response"), F.array(context).alias("retrieved_contexts"), F.col(reference).alias("reference"))


def outcomes(answered: DataFrame, by: str, error: Column) -> DataFrame:
    """Successes and errors of each group."""
    return answered.groupBy(by).agg(F.count_if(error.isNull()).alias("n_ok"), F.count_if(error.isNotNull()).alias("n_failed"))


def metric_means(scores: DataFrame, by: str, *metrics: str) -> DataFrame:
    return scores.groupBy(by).agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics])


def trials(grid: dict[str, list[int]], spark) -> DataFrame:
    """Every configuration of a grid of chunk sizes and overlaps, and whether it can be run (the dry run's verdict)."""
    from itertools import product

    rows = spark.createDataFrame(list(product(*grid.values())), ", ".join(f"{k} int" for k in grid))
    return rows.withColumn("valid", (F.col("size") > 0) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("size")))


def run_trials(docs: DataFrame, configurations: DataFrame) -> DataFrame:
    """Chunks that each valid configuration makes of all documents, and their number a document. Documents are counted by length first, so configurations meet lengths and not documents."""
    n = F.greatest(F.ceil((F.col("chars") - F.col("overlap")) / (F.col("size") - F.col("overlap"))), F.lit(1))
    lengths = docs.where(F.col("text").isNotNull()).groupBy(F.char_length("text").alias("chars")).agg(F.count("*").alias("docs"))
    rows = lengths.crossJoin(configurations.where("valid"))
    return rows.groupBy("size", "overlap").agg(F.sum(n * F.col("docs")).cast("long").alias("n_chunks"), F.round(F.sum(n * F.col("docs")) / F.sum("docs"), 6).alias("per_document"))


def label_metrics(ranked: DataFrame, labels: DataFrame, k: int, id_col: str) -> DataFrame:
    """retrieval_metrics where a row is relevant to a query of the same label, itself left out: ranked (query_id, id, rank), labels (id, label). Labels of found rows are compared and labels counted, so nothing grows with the pairs of a label."""
    of = lambda name, to: labels.select(F.col(id_col).alias(name), F.col("label").alias(to))
    hit = (F.col("query_label") == F.col("own_label")).cast("int")
    per = ranked.where(F.col("rank") <= k).join(of(id_col, "own_label"), id_col).join(of("query_id", "query_label"), "query_id")
    per = per.groupBy("query_id", "query_label").agg(F.sum(hit).alias("hits"), F.min(F.when(hit == 1, F.col("rank"))).alias("first"))
    total = labels.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("n"))
    hits = F.coalesce("hits", F.lit(0))
    return per.join(total, "query_label", "left").select(
        "query_id", F.round(hits / k, 6).alias("precision"), F.round(F.coalesce(hits / F.when(F.col("n") > 0, F.col("n")), F.lit(0.0)), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr")
    )


def token_f1(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """ids and f1 of rows (ids, a, b) with two token arrays, as multisets; 0 if either is empty. Tokens are counted by groups, in time linear in their number. A proxy of factual correctness, not a judge's."""
    sizes = pairs.select(*ids, F.size("a").alias("na"), F.size("b").alias("nb"))
    each = lambda c, x, y: pairs.select(*ids, F.explode(c).alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    both = each("a", 1, 0).union(each("b", 0, 1)).groupBy(*ids, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    both = both.groupBy(*ids).agg(F.sum(F.least("x", "y")).alias("both"))
    f1 = F.when((F.col("na") == 0) | (F.col("nb") == 0), F.lit(0.0)).otherwise(2.0 * F.col("both") / (F.col("na") + F.col("nb")))
    return sizes.join(both, ids, "left").select(*ids, F.coalesce(f1, F.lit(0.0)).alias("f1"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn))


def band(score: Column, baseline: float = 0.5, target: float = 0.7) -> Column:
    return F.when(score >= target, "target").when(score >= baseline, "baseline").otherwise("below")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by a row of bits: bit i is zero where one more token of ``a`` up to i is matched."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(a: list[str], b: list[str]) -> float:
    """F-measure of the longest common subsequence of tokens."""
    n = lcs(a, b)
    return 2 * n / (len(a) + len(b)) if n else 0.0


def bleu(candidate: list[str], reference: list[str], n: int = 4) -> float:
    """BLEU of one pair with add-one smoothing beyond unigrams and the brevity penalty."""
    if not candidate or not reference:
        return 0.0
    total = 0.0
    for k in range(1, n + 1):
        c, r = (Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (candidate, reference))
        good, all_ = sum((c & r).values()), sum(c.values())
        if k == 1 and not good:
            return 0.0
        total += log((good + (k > 1)) / (all_ + (k > 1)))
    return exp(total / n) * min(1.0, exp(1 - len(reference) / len(candidate)))


def text_scores(pairs: DataFrame) -> DataFrame:
    """id, rouge_l, bleu of (id, candidate, reference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                scores = [(round(rouge_l(x, y), 6), round(bleu(x, y), 6)) for x, y in ([(t.as_py() or "").lower().split() for t in pair] for pair in zip(part.column(1), part.column(2)))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([z[c] for z in scores], pa.float64()) for c in (0, 1))], names=["id", "rouge_l", "bleu"])

    return pairs.select(F.col("id").cast("string"), "candidate", "reference").mapInArrow(run, "id string, rouge_l double, bleu double")
