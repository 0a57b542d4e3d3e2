"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage is a function of (spark, docs, sf_dir) over a table with the columns of ``documents``;
all but the last return those columns, decided by the operator the stage calls:

1. documents that fail the quality rules go;
2. of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one stays;
3. documents contaminated by benchmark text go;
4. secrets in the text are masked, and n_chars follows the text;
5. texts are encoded: doc_id, n_tokens and digests of the ids and of the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bpe, decontamination, near_duplicates, quality_rules, secrets
from ravelin.llm._store import remove, saved, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_duplicates(docs, k=5, percent=80, copies=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, bpe.default_vocabulary())


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicate), ("decontamination", decontaminate), ("secret_scans", mask_secrets), ("bpe", encode)]
#: Components and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written once to the shared folder and read again by the next; the last one's are returned as planned."""
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), folder, name)
        if last:
            remove(spark, f"{folder}/{last}")
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
