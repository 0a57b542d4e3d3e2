"""Splitting documents into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of texts after which a task's Python hands on their chunks.
CHARS = 1 << 20

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def sliding_chunks(docs: DataFrame, size: int = 512, overlap: int = 128, id_col: str = "doc_id") -> DataFrame:
    """doc_id, chunk_no, text, n_chars of windows that start every ``size - overlap`` characters."""
    step = size - overlap
    n = F.greatest(F.ceil((F.char_length("text") - overlap) / step), F.lit(1)).cast("int")
    rows = docs.where(F.col("text").isNotNull()).select(id_col, "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return rows.select(id_col, "chunk_no", F.substring("text", F.col("chunk_no") * step + 1, F.lit(size)).alias("text")).withColumn("n_chars", F.char_length("text"))


def _parts(text: str, size: int, separators: tuple[str, ...], length: Callable[[str], int]) -> list[str]:
    """Pieces of at most ``size`` cut at the coarsest separator that does; separators stay at the end of a piece."""
    if length(text) <= size:
        return [text]
    sep = next((s for s in separators if s and s in text), "")
    if not sep:
        return [text[i : i + size] for i in range(0, len(text), size)]
    finer = separators[separators.index(sep) + 1 :]
    cut = text.split(sep)
    whole = [x + sep for x in cut[:-1]] + ([cut[-1]] if cut[-1] else [])
    return [p for x in whole for p in _parts(x, size, finer, length)]


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS, length: Callable[[str], int] = len) -> list[str]:
    """Chunks of whole pieces, each at most ``size``, that repeat up to ``overlap`` of the chunk before."""
    out: list[str] = []
    held: list[str] = []
    total = fresh = 0
    for p in _parts(text, size, separators, length):
        n = length(p)
        if held and total + n > size:
            out.append("".join(held))
            while held and (total > overlap or total + n > size):
                total -= length(held.pop(0))
            fresh = 0
        held.append(p)
        total += n
        fresh += 1
    if held and fresh:
        out.append("".join(held))
    return [c for c in (x.strip() for x in out) if c]


def recursive_chunks(docs: DataFrame, size: int = 512, overlap: int = 128, separators: tuple[str, ...] = SEPARATORS, unit: str = "chars", id_col: str = "doc_id") -> DataFrame:
    """doc_id, chunk_no, text, n_chars; sizes in characters or white-space words (``unit``)."""
    length = len if unit == "chars" else lambda s: len(s.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), pa.array(no, pa.int32()), pa.array(text, pa.string()), pa.array(map(len, text), pa.int32())], names=[id_col, "chunk_no", "text", "n_chars"])

        for batch in batches:
            ids, no, text, held = [], [], [], 0
            for d, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                chunks = recursive_split(t, size, overlap, separators, length) if t else []
                ids += [d.as_py()] * len(chunks)
                no += range(len(chunks))
                text += chunks
                held += len(t or "")
                if held >= CHARS:
                    yield made()
                    ids, no, text, held = [], [], [], 0
            yield made()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"{id_col} {kind}, chunk_no int, text string, n_chars int")


def header_sections(docs: DataFrame, id_col: str = "doc_id", levels: int = 3) -> DataFrame:
    """Sections of markdown by headings: doc_id, section_no, header_1.. and text. A heading resets the deeper ones."""
    lines = docs.select(id_col, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    level = F.char_length(F.regexp_extract("line", rf"^(#{{1,{levels}}})\s+\S", 1))
    w = Window.partitionBy(id_col).orderBy("line_no")
    lines = lines.withColumn("level", level).withColumn("section_no", F.sum(F.when(level > 0, 1).otherwise(0)).over(w))
    name = F.trim(F.regexp_replace("line", r"^#+\s+", ""))
    for k in range(1, levels + 1):
        mark = F.when(F.col("level") == k, name).when((F.col("level") > 0) & (F.col("level") < k), F.lit(""))
        lines = lines.withColumn(f"header_{k}", F.nullif(F.last(mark, ignorenulls=True).over(w), F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(id_col, "section_no", *[f"header_{k}" for k in range(1, levels + 1)]).agg(F.trim(body).alias("text")).where("text <> ''")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n = F.char_length("text")
    return chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 6).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))
