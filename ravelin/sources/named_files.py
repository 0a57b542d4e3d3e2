"""A sink that writes one file a row under the row's own name.

Rows are (name, body). A task writes its files beside their names and gives them their names only when all are written; a task that fails takes its
files away, and an aborted job those of the tasks that had ended. The commit leaves the list of names as ``_files.json``.
Rows of one name follow each other in any order and the last one stays, so names should be told apart before.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ravelin_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"], overwrite)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator[Row]) -> Written:
        files, base = self._store()
        own = f"{base}/_task-{uuid.uuid4().hex}"
        files.create_dir(own)
        names: dict[str, None] = {}
        try:
            for r in rows:
                if not r["name"] or re.search(r"[/\\\x00]|^[._]", r["name"]):
                    raise ValueError(f"not a file name: {r['name']!r}")
                with files.open_output_stream(f"{own}/{r['name']}") as out:
                    out.write((r["body"] or "").encode())
                names[r["name"]] = None
            for n in names:
                files.move(f"{own}/{n}", f"{base}/{n}")
        finally:
            files.delete_dir(own)
        return Written(list(names))

    def commit(self, messages: list[Written | None]) -> None:
        files, base = self._store()
        names = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(base)):
                if x.type == fs.FileType.File and x.base_name not in names:
                    files.delete_file(x.path)
        with files.open_output_stream(f"{base}/_files.json") as out:
            out.write(json.dumps(sorted(names), ensure_ascii=False).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, base = self._store()
        for n in {n for m in messages if m for n in m.names}:
            files.delete_file(f"{base}/{n}")


def write(named: DataFrame, path: str) -> None:
    """Write (name, body) rows as files of those names below ``path``; files of other names go."""
    named.sparkSession.dataSource.register(FilesSink)
    named.select("name", "body").write.format("ravelin_files").mode("overwrite").save(path)
