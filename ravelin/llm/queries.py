"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import _graph, _store, bpe, decontamination, hard_negatives, html_text, near_duplicates, prefix_trie, quality_rules, secrets, shards, simhash, substring_dedup, token_counts, token_files
from ravelin.llm.sql import ORACLE_SQL as ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the vocabulary under two tokenizer versions: special tokens' strings as tokens (``special``) and as text (``plain``).

    Four batches over all documents, each sent twice: inserts under both versions, a revision of the first (every document
    gets an end token), and deletes under both of the later copies of equal texts: rows whose doc_id is greater
    than the smallest one with that text. A row without doc_id is never taken for a copy. The totals are read from
    a base that the batches are folded into.
    """
    docs = table(spark, sf_dir, "documents")
    folder = _store.shared_dir(spark)
    counted = _store.saved(bpe.count_ids(docs, bpe.default_vocabulary(), ("source", "lang")), folder, "counted")
    same = _graph.beside_group(counted.where("doc_id is not null"), ["text_sha256"], ["doc_id"], first=("min", "doc_id"))
    later = same.where(F.col("doc_id") > F.col("first"))
    n, end, plain = F.col("n_tokens"), F.col("n_tokens") + 1, F.col("n_plain")
    rollup = token_counts.Rollup(spark, f"{folder}/rollup")
    for _ in range(2):
        rollup.apply("1-special", token_counts.changes(counted, "insert", "special", n))
        rollup.apply("2-plain", token_counts.changes(counted, "insert", "plain", plain))
        rollup.apply("3-end-token", token_counts.changes(counted, "revise", "special", end, n))
        rollup.apply("4-copies", token_counts.changes(later, "delete", "special", end).union(token_counts.changes(later, "delete", "plain", plain)))
    rollup.fold()
    return rollup.totals()


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


#: Arrivals that op8_shards makes of the documents.
ARRIVALS = 8


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in eight batches as small shards, are compacted and read back from the newest manifest; ``compacted`` tells that it leaves no run of small shards to merge.

    A document's batch follows from its doc_id alone, whatever the size of the table and its files.
    """
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, f"{_store.shared_dir(spark)}/shards")
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    compacted = not store.due(store.compact())
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.lit(compacted).alias("compacted"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 35)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = _store.shared_dir(spark) + "/tokens"
    return token_files.read(spark, folder, token_files.tokens_to_files(docs, folder, bpe.default_vocabulary(), _store.parts(docs)))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), k=3, distance=3)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vec_id are moved on by one before mining."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_near_duplicates, op3_token_counts, op4_main_text, op5_secrets, op6_quality_rules, op7_substring_dedup, op8_shards, op9_token_files, op10_decontamination, op11_simhash, op12_prefix_trie, op13_hard_negatives)
}
