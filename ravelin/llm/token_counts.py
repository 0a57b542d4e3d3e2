"""Token counts as delta-maintained rollups.

A batch is a table of signed changes: ``insert`` adds a document's tokens, ``delete`` takes them
away, ``revise`` replaces an old count by a new one. A change carries the counts it needs, so
totals by source, language and tokenizer version are sums and no earlier batch is read again.

A rollup is a folder of the shared store. A batch is summed to one row a group, written to
``delta/<attempt>`` and committed by making the next numbered log entry, which names batch and
attempt, whole and without overwriting. A writer that finds its number taken reads the log again, so a
batch counts once however often and by however many drivers it is sent; what an uncommitted attempt
has written is not read, and a driver lost at any step leaves nothing that stops the next.

Every ``FOLD`` batches the totals and the names of all batches so far are written as a base, named
by a numbered file made in the same way. Totals are the base and at most about ``FOLD`` deltas
behind it, whatever the number of batches ever sent; the log is kept in folders of ``SEGMENT``
entries, of which only those since the base are listed.

Defined cases: null keys are groups of their own; null counts are 0; a batch without changes is
committed and adds nothing; repeated rows are repeated changes; groups whose documents and tokens
are all taken away stay out of the totals; other columns are not read; a batch may have any name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm._store import create_once, file_text, names_in, remove

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Batches behind a base that make a new one; log entries a folder.
FOLD, SEGMENT = 16, 1000


def changes(docs: DataFrame, op: str, tokenizer: str, tokens: Column, old: Column | None = None) -> DataFrame:
    """Signed changes of documents that have source and lang columns: ``tokens`` is the count that the change is about, ``old`` the one a revision replaces."""
    zero = F.lit(0).cast("long")
    n = F.coalesce(tokens.cast("long"), zero)
    docs_, tokens_ = {
        "insert": (F.lit(1), n),
        "delete": (F.lit(-1), -n),
        "revise": (F.lit(0), n - F.coalesce((old if old is not None else zero).cast("long"), zero)),
    }[op]
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), docs_.cast("long").alias("docs"), tokens_.alias("tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _base(self) -> dict:
        """{version, folder} of the newest base; version 0 has no folder."""
        found = [n for n in names_in(self.spark, f"{self.folder}/bases") if n.endswith(".json")]
        return json.loads(file_text(self.spark, f"{self.folder}/bases/{found[-1]}")) if found else {"version": 0, "folder": None}

    def _entry(self, version: int) -> str:
        return f"{self.folder}/log/{version // SEGMENT:09d}/{version:012d}.json"

    def _tail(self, base: dict) -> list[dict]:
        """Log entries behind a base: {version, batch, attempt}, ascending."""
        out, segment = [], (base["version"] + 1) // SEGMENT
        while names := names_in(self.spark, f"{self.folder}/log/{segment:09d}"):
            for n in names:
                if int(n[:-5]) > base["version"]:
                    out.append({"version": int(n[:-5])} | json.loads(file_text(self.spark, self._entry(int(n[:-5])))))
            segment += 1
        return out

    def committed(self, batch: str) -> bool:
        base = self._base()
        return self._known(batch, base, self._tail(base))

    def _known(self, batch: str, base: dict, tail: list[dict]) -> bool:
        if any(e["batch"] == batch for e in tail):
            return True
        return base["folder"] is not None and not self._names(base).where(F.col("batch") == batch).isEmpty()

    def _names(self, base: dict) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{base['folder']}/names")

    def apply(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch of signed changes; False if it was committed before."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        _summed(signed).write.parquet(f"{self.folder}/delta/{attempt}")
        while True:
            base = self._base()
            tail = self._tail(base)
            if self._known(batch, base, tail):
                # another driver was faster
                remove(self.spark, f"{self.folder}/delta/{attempt}")
                return False
            version = 1 + (tail[-1]["version"] if tail else base["version"])
            if create_once(self.spark, self._entry(version), json.dumps({"batch": batch, "attempt": attempt}).encode()):
                break
        if len(tail) + 1 >= FOLD:
            self.fold()
        return True

    def fold(self) -> int:
        """Write what is committed as a base; returns its version."""
        base = self._base()
        tail = self._tail(base)
        if not tail:
            return base["version"]
        version, folder = tail[-1]["version"], f"{self.folder}/base/{uuid.uuid4().hex}"
        self._rows(base, tail).coalesce(1).write.parquet(f"{folder}/totals")
        new = self.spark.createDataFrame([(e["batch"],) for e in tail], "batch string")
        (self._names(base).union(new) if base["folder"] else new).coalesce(1).write.parquet(f"{folder}/names")
        if not create_once(self.spark, f"{self.folder}/bases/{version:012d}.json", json.dumps({"version": version, "folder": folder}).encode()):
            remove(self.spark, folder)
        return version

    def _rows(self, base: dict, tail: list[dict]) -> DataFrame:
        paths = [f"{self.folder}/delta/{e['attempt']}" for e in tail] + ([f"{base['folder']}/totals"] if base["folder"] else [])
        return _summed(self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        base = self._base()
        return self._rows(base, self._tail(base)).where("docs <> 0 or tokens <> 0")
