"""Shared scratch folder, small filesystem helpers and text batching."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy step holds at a time; a longer document is a step of its own.
STEP_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent (tests on one machine) a temporary folder takes its place, which goes when the
    driver ends. Results are read from such folders, so those on a cluster stay until release() takes them away.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ravelin-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    _made.append(f"{base.rstrip('/')}/ravelin-{uuid.uuid4().hex}")
    return _made[-1]


#: Folders this driver was given.
_made: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete every folder that shared_dir() gave this driver; for use when no result is read any more."""
    n = len(_made)
    while _made:
        remove(spark, _made.pop())
    return n


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once below ``folder`` and read it back, so later steps neither recompute it nor depend on executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_of(spark: SparkSession, path: str):
    """The store's file system and its class of paths."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def create_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Make a small file with all its content at once; False, and nothing changed, if the path exists.

    The content is written beside under a name of its own and given the path by a link (mounted disks) or by a rename
    that doesn't overwrite (other stores; atomic where the store's renames are, as in HDFS). A driver lost on the way
    leaves a hidden file that nobody reads, never a part of the file or a claim on the path.
    """
    fs, kind = store_of(spark, path)
    beside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs.mkdirs(kind(path).getParent())
    if fs.getUri().getScheme() == "file":
        here, there = (urllib.parse.unquote(urllib.parse.urlparse(kind(x).toUri().toString()).path) for x in (beside, path))
        with open(here, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(here, there)
        except FileExistsError:
            return False
        finally:
            os.unlink(here)
        return True
    out = fs.create(kind(beside), False)
    out.write(bytearray(content))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    try:
        none = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0)
        jvm.FileContext.getFileContext(kind(path).toUri(), spark._jsc.hadoopConfiguration()).rename(kind(beside), kind(path), none)
    except Exception:
        fs.delete(kind(beside), False)
        if fs.exists(kind(path)):
            return False
        raise
    return True


def file_text(spark: SparkSession, path: str) -> str:
    fs, kind = store_of(spark, path)
    stream = fs.open(kind(path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "utf-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder but hidden files, ascending; none if there is no folder."""
    fs, kind = store_of(spark, path)
    if not fs.exists(kind(path)):
        return []
    found = (f.getPath().getName() for f in fs.listStatus(kind(path)))
    return sorted(n for n in found if n[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parts(df: DataFrame, bytes_each: int = 16 << 20, least: int = 4) -> int:
    """Number of parts of about ``bytes_each`` by the size Spark estimates for the input files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // bytes_each))


def text_steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, list[bytes]]]:
    """Cut a batch into row ranges of about STEP_BYTES of text; yields (first row, row after the last, UTF-8 texts).

    The column is binary (a string cast); null counts as empty.
    """
    held = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(held), 0).to_pylist()
    first = size = 0
    for k, n in enumerate([*sizes, STEP_BYTES]):
        if k > first and size + n > STEP_BYTES or k == len(sizes) > first:
            yield first, k, [t or b"" for t in held.slice(first, k - first).to_pylist()]
            first, size = k, 0
        size += n + 1
