"""Sinks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.text import last_segment, safe_name


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that isn't set and driver and executors are one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ravelin-')}"
    return f"{base.rstrip('/')}/ravelin-{uuid.uuid4().hex}"


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def train_test(df: DataFrame, path: str, ratio: float, order: list[str]) -> None:
    from ravelin.operators.relational import positional_split

    both = positional_split(df, ratio, order)
    for name in ("train", "test"):
        both.where(F.col("part") == name).drop("part", "position").write.mode("overwrite").parquet(f"{path}/{name}")


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def pretty_json(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true"})


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the collection at ``path`` doesn't hold yet; sending rows again adds nothing, null keys included.

    Of rows that share their keys the one with the least digest of all its columns is taken, the same at every send.
    """
    from ravelin.sources.readers import collection

    held = collection(df.sparkSession, path)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    df = df.groupBy(*keys).agg(F.min_by(whole, F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)).alias("row")).select("row.*")
    if held is not None:
        old = held.select(*[F.col(k).alias(f"held_{k}") for k in keys]).distinct()
        same = reduce(lambda x, y: x & y, [df[k].eqNullSafe(old[f"held_{k}"]) for k in keys])
        df = df.join(old, same, "left_anti")
    df.write.mode("append").parquet(path)


def markdown_chunks(chunks: DataFrame) -> DataFrame:
    """(name, body) of one markdown file a chunk: title, metadata block, text; named <file>_chunk_<nnn>."""
    stem = safe_name(F.coalesce(F.try_element_at("metadata", F.lit("filename")), F.lit("unknown")))
    n = F.row_number().over(Window.partitionBy(stem).orderBy("doc_id", "chunk_no"))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n")
    rows = chunks.select(stem.alias("stem"), n.alias("n"), lines.alias("meta"), "text")
    return rows.select(F.format_string("%s_chunk_%03d.md", "stem", "n").alias("name"), F.format_string("# %s chunk %d\n\n## Metadata\n\n%s\n\n## Content\n\n%s\n", "stem", "n", "meta", "text").alias("body"))


def page_names(pages: DataFrame) -> DataFrame:
    """url and file name: the title, with the last part of the url where an earlier page has the title."""
    n = F.row_number().over(Window.partitionBy("title").orderBy("url"))
    return pages.select("url", F.when(n == 1, F.col("title")).otherwise(F.concat("title", F.lit("_"), last_segment(F.col("url")))).alias("name"))


def text_files(named: DataFrame, path: str) -> None:
    """Write (name, body) rows as files of those names."""
    from ravelin.sources import named_files

    named_files.write(named, path)
