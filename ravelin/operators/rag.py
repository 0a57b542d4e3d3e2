"""Answering over retrieved context, with model calls behind plain functions.

A model is any function of a list of strings to a list of strings (or vectors). The offline ones
here are deterministic, so that the flow around them can be tested without a network.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Generate = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], list[list[float]]]


def hashed_embedding(texts: list[str], dims: int = 64) -> list[list[float]]:
    """Feature hashing of lower-cased words, scaled to length 1."""
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())
            out[i, h % dims] += 1 if h >> 63 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)).tolist()


def extractive(prompts: list[str]) -> list[str]:
    """First sentence of the prompt's context that shares a word with its question, else its first."""
    out = []
    for p in prompts:
        context, _, question = (p or "").rpartition("Question:")
        words = set(question.lower().split())
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", context) if s.strip()] or [""]
        out.append(next((s for s in sentences if words & set(s.lower().split())), sentences[0]))
    return out


def embed(df: DataFrame, column: str, model: Embed = hashed_embedding, batch: int = 32) -> DataFrame:
    """``df`` with an ``embedding`` of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*b.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, embedding array<double>")


def generate(df: DataFrame, prompt: str, model: Generate = extractive, tries: int = 2, batch: int = 32, skip_null: bool = False) -> DataFrame:
    """``df`` with ``answer`` and ``error``, both null for a null prompt that is to be skipped. The model is called with ``batch`` prompts at a time; only those of a batch that
    failed are tried one by one, and one that fails ``tries`` times has the error and no answer, and stops no other."""

    def one(text: str) -> tuple[str | None, str | None]:
        for k in range(tries):
            try:
                return model([text])[0], None
            except Exception as e:  # noqa: BLE001  any failure of the model is the row's
                if k == tries - 1:
                    return None, str(e)
        return None, None

    def some(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            said = model(texts)
        except Exception:  # noqa: BLE001
            said = []
        return [(x, None) for x in said] if len(said) == len(texts) else [one(t) for t in texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(prompt)).to_pylist()
            ask = [j for j, t in enumerate(texts) if t is not None or not skip_null]
            got: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
            for i in range(0, len(ask), batch):
                for j, x in zip(ask[i : i + batch], some([texts[j] for j in ask[i : i + batch]])):
                    got[j] = x
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([g[k] for g in got], pa.string()) for k in (0, 1))], names=[*b.schema.names, "answer", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, answer string, error string")


def checked_json(answer: Column, schema: str) -> Column:
    """The record of a JSON answer; null for what isn't JSON, isn't of the schema or leaves out one of its fields."""
    kept = StructType.fromDDL(schema)
    got = F.from_json(answer, StructType([*kept.fields]).add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"})
    whole = reduce(lambda x, f: x & got[f.name].isNotNull(), kept.fields, got["_bad"].isNull())
    return F.when(whole, F.struct(*[got[f.name].alias(f.name) for f in kept]))


def structured(df: DataFrame, column: str, schema: str, empty: dict) -> DataFrame:
    """``parsed`` from a column of JSON answers; what doesn't parse is the empty record."""
    return df.withColumn("parsed", F.coalesce(checked_json(F.col(column), schema), F.from_json(F.lit(json.dumps(empty)), schema)))


def rewritten(rows: DataFrame, prompt: str, schema: str, path: str, strict: Generate, plain: Generate | None = None, keys: tuple[str, ...] = ("id",), batch: int = 32) -> DataFrame:
    """Rewrite rows into records, as far as earlier runs haven't: keys, parsed, error and tries of all rows at ``path`` that have a record or failed in this run.

    Rows are asked of ``strict`` (which should answer in JSON). Those alone whose call fails or whose answer isn't a record of ``schema`` are asked once more, of ``plain``
    if given. What fails twice has a null record and the last error, is not appended, so the next run tries it again, and is a line of the run's error list under
    ``path``/errors. Records are appended to ``path``/done by key, so a run that dies and starts again repeats no record. A null prompt fails without a call.
    """
    from ravelin.sources import sinks
    from ravelin.sources.readers import collection

    spark, folder, at = rows.sparkSession, sinks.scratch(rows.sparkSession), [f"`{k}`" for k in keys]
    held = collection(spark, f"{path}/done")
    if held is not None:
        old = held.select(*[F.col(k).alias(f"held_{n}") for n, k in enumerate(at)])
        rows = rows.join(old, reduce(lambda x, y: x & y, [rows[k].eqNullSafe(old[f"held_{n}"]) for n, k in enumerate(keys)]), "left_anti")
    # answers are written before they are looked at, so that no call is made twice
    asked = rows.select(*at, F.col(prompt).alias("prompt"))
    for n, model in ((1, strict), (2, plain or strict)):
        said = generate(asked, "prompt", model, tries=1, batch=batch, skip_null=True).withColumn("parsed", checked_json(F.col("answer"), schema))
        wrong = F.when(F.col("prompt").isNull(), "no prompt").otherwise(F.coalesce("error", F.lit("not a record")))
        said.select(*at, "prompt", "parsed", F.when(F.col("parsed").isNull(), wrong).alias("error"), F.lit(n).alias("tries")).write.parquet(f"{folder}/{n}")
        asked = spark.read.parquet(f"{folder}/{n}").where("parsed is null").select(*at, "prompt")
    first, second = (spark.read.parquet(f"{folder}/{n}") for n in (1, 2))
    got = first.where("parsed is not null").unionByName(second).drop("prompt")
    sinks.append_new(got.where("parsed is not null"), f"{path}/done", list(keys))
    failed = got.where("parsed is null")
    failed.select(F.concat(F.to_json(F.struct(*at)), F.lit("\t"), "error").alias("value")).write.mode("append").text(f"{path}/errors")
    return spark.read.parquet(f"{path}/done").unionByName(failed)


def hyde_vector(hypothetical: list[str], model: Embed = hashed_embedding) -> list[float]:
    """Mean of the embeddings of hypothetical answers."""
    return np.mean(np.array(model(hypothetical)), axis=0).tolist()


def overlap_rerank(candidates: DataFrame, query: list[str], id_col: str = "doc_id") -> DataFrame:
    """Candidates by the share of query terms their text holds; stands in for a learned reranker."""
    from ravelin.functions.text import tokens

    terms = sorted(set(query))
    hit = F.size(F.array_intersect(tokens(F.col("text")), F.array(*map(F.lit, terms))))
    return candidates.select(id_col, F.round(hit / len(terms), 6).alias("score"))


def faithfulness(answers: DataFrame) -> DataFrame:
    """id and share of an answer's sentences that its context supports: (id, answer, context). Offline support is half of a sentence's words."""
    from ravelin.functions.text import tokens

    claims = answers.select("id", F.explode(F.filter(F.split("answer", r"[.!?\n]+"), lambda s: F.trim(s) != "")).alias("claim"), tokens(F.col("context")).alias("c"))
    words = F.array_distinct(tokens(F.col("claim")))
    supported = 2 * F.size(F.array_intersect(words, F.col("c"))) >= F.size(words)
    return claims.groupBy("id").agg(F.round(F.avg(F.when(supported, 1.0).otherwise(0.0)), 6).alias("faithfulness"))


def testset_quota(chunks: DataFrame, n: int, single: float = 0.7) -> DataFrame:
    """The n chunks of least hash with the kind of question to ask: single-hop for the first share, then multi-hop."""
    from pyspark.sql import Window

    order = [F.md5(F.concat_ws("-", "doc_id", "chunk_no")), "doc_id", "chunk_no"]
    got = chunks.orderBy(*order).limit(n)
    k = F.row_number().over(Window.orderBy(*order))  # n rows
    return got.withColumn("place", k).withColumn("kind", F.when(k <= int(n * single), "single-hop").otherwise("multi-hop"))


def agent_rounds(tasks: DataFrame, decide: Generate, tools: dict[str, Callable], most: int = 4) -> DataFrame:
    """Run every task's decide, act, observe loop, one DataFrame stage a round: (id, prompt) to (id, trace, answer).

    Unfinished tasks go on with their observations in the prompt, at most ``most`` rounds; finished ones pass the model by,
    so each round is one more step over the same rows.
    """
    from ravelin.functions.text import action, action_input, final_answer

    state = tasks.select("id", "prompt", F.array().cast("array<string>").alias("trace"), F.lit(None).cast("string").alias("had"))
    for _ in range(most):
        going = F.col("had").isNull()
        step = generate(state.withColumn("ask", F.when(going, F.col("prompt"))), "ask", decide, skip_null=True).withColumnRenamed("answer", "said")
        seen = F.lit("no such tool")
        for name, tool in tools.items():
            seen = F.when(action(F.col("said")) == name, tool(action_input(F.col("said")))).otherwise(seen)
        done = final_answer(F.col("said"))
        acted = F.concat("trace", F.array(F.concat_ws(" -> ", action(F.col("said")), seen)))
        state = step.select(
            "id", F.when(going, F.concat("prompt", F.lit("\nObservation: "), seen)).otherwise(F.col("prompt")).alias("prompt"),
            F.when(going & done.isNull(), acted).otherwise(F.col("trace")).alias("trace"), F.coalesce("had", done).alias("had"),
        )
    return state.select("id", "trace", F.col("had").alias("answer"))


def synthesized_qa(contents: DataFrame, model: Generate, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, question, answer) pairs that a model's ``[Q]:`` and ``[A]:`` marks give for each content; contents whose call fails give none."""
    from ravelin.functions.text import qa_pairs

    said = generate(contents.select(F.col(id_col).alias("id"), F.col(text_col).alias("prompt")), "prompt", model)
    return said.where("error is null").select("id", F.explode(qa_pairs(F.col("answer"))).alias("p")).select("id", "p.question", "p.answer")


def multi_hop_pairs(chunks: DataFrame, most: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(a, b, shared): chunks that share rare terms, those that between two and ``most`` chunks hold, and how many they share.

    A term links at most ``most`` chunks, so the pairs grow with the chunks and no term gathers many.
    """
    from ravelin.functions.text import tokens

    held = chunks.select(id_col, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    rare = held.groupBy("term").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select("term")
    few = held.join(rare, "term").groupBy("term").agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    both = few.select("term", "ids", F.explode("ids").alias("a")).select("term", "a", F.explode("ids").alias("b")).where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))
