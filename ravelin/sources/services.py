"""Stored answers of a web service (timetables, routes, search hits) as a Spark data source.

Answers lie as JSON lines below ``<path>/<key>=<value>/``, a folder for each value of the request's parameter. A folder is a partition; an
equality or IN filter on the key is pushed down, so the answers of other requests are never opened. With ``limit`` a reader gives the first
answers of each request only, as a service that returns so many hits does.

    spark.dataSource.register(ServiceSource)
    spark.read.format("ravelin_service").schema("station long, train string").option("key", "station").load(path).where("station = 4")
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

_PUSH = "spark.sql.python.filterPushdown.enabled"


class ServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ravelin_service"

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = PushedReader if self.options.get("push") == "true" else ServiceReader
        return kind(self.options["path"], self.options["key"], int(self.options.get("limit", 0)), schema)


class Request(InputPartition):
    """One value of the key and its folder."""

    def __init__(self, folder: str, key: str):
        self.folder, self.key = folder, key


class ServiceReader(DataSourceReader):
    def __init__(self, path: str, key: str, limit: int, schema: StructType):
        self.path, self.key, self.limit, self.fields = path, key, limit, [(f.name, f.dataType.typeName()) for f in schema.fields]
        self.wanted: set[str] | None = None

    def partitions(self) -> list[Request]:
        files, base = fs.FileSystem.from_uri(self.path)
        out = []
        for x in sorted(files.get_file_info(fs.FileSelector(base, allow_not_found=True)), key=lambda x: x.path):
            name, sep, value = x.base_name.partition("=")
            value = urllib.parse.unquote(value)
            if sep and name == self.key and (self.wanted is None or value in self.wanted):
                out.append(Request(x.path, value))
        return out or [Request("", "")]

    def read(self, partition: Request) -> Iterator[tuple]:
        if not partition.folder:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        n = 0
        for x in sorted(files.get_file_info(fs.FileSelector(partition.folder)), key=lambda x: x.path):
            if x.base_name[0] in "._":
                continue
            with files.open_input_stream(x.path, compression=None) as f:
                for line in f.read().decode().splitlines():
                    if self.limit and n >= self.limit:
                        return
                    n += 1
                    row = json.loads(line) | {self.key: partition.key}
                    yield tuple(_typed(row.get(c), kind) for c, kind in self.fields)


class PushedReader(ServiceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what names values of the key; leaves the rest to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == (self.key,):
                values = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


def _typed(value, kind: str):
    if value is None or kind == "string" and isinstance(value, str):
        return value
    return int(value) if kind in ("long", "integer") else float(value) if kind == "double" else value if kind == "boolean" else value if not isinstance(value, dict | list) else json.dumps(value, ensure_ascii=False)


def store(answers: DataFrame, path: str, key: str) -> None:
    """Keep rows as the answers of requests, for ServiceSource."""
    answers.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


@contextmanager
def pushdown(spark: SparkSession):
    """Filters reach Python sources while a query is planned within; the session's setting is put back."""
    before = spark.conf.get(_PUSH, None)
    spark.conf.set(_PUSH, "true")
    try:
        yield
    finally:
        spark.conf.set(_PUSH, before) if before else spark.conf.unset(_PUSH)


def answers(spark: SparkSession, path: str, schema: str, key: str, limit: int = 0) -> DataFrame:
    """Stored answers; filters reach them if this is called, and the query run, within pushdown()."""
    spark.dataSource.register(ServiceSource)
    return spark.read.format("ravelin_service").schema(schema).option("key", key).option("limit", limit).option("push", spark.conf.get(_PUSH, "false")).load(path)
