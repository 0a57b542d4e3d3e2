"""Shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction looks at the shards by tier
(the power of ``fanout`` that their size is below the target) and merges the runs of a tier that
has at least ``fanout`` shards, or together a target's size, into files of about the target size;
full shards are left alone. It goes on while what was merged fills another tier and leaves fewer shards.

Every change writes its shards first and then makes the next numbered manifest, whole and without
overwriting; readers take the newest manifest, so they see all of a change or nothing, and older
versions stay readable until vacuumed. A writer that finds its number taken reads the newest
manifest and goes on from there: an append adds its shards to it, a merge counts if the shards it
replaces are still listed and is otherwise done anew. A writer lost at any step leaves files that no
manifest names and blocks nobody.

The manifest's schema is that of all arrivals together: a column that some of them lack is null
there, in every version since it came, also after its shards were merged. A column that comes back
with another type, or differs from one by case alone, is refused before anything is committed.

Merging is one Spark job a tier without a shuffle: the file source packs whole small files into read
partitions of the target size, and each partition is written as one file. A lost executor costs
the repetition of its tasks; files of failed attempts are in no manifest.

Defined cases: an empty arrival adds no rows but makes a version; null values and columns of
any name are kept as they are; repeated rows stay repeated; the rows of a shard have no order.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ravelin.llm._store import create_once, file_text, names_in, remove, store_of

TARGET, FANOUT = 128 << 20, 4


def merged_schema(old: StructType | None, new: StructType) -> StructType:
    """Columns of both, all nullable; ValueError where they contradict each other."""
    out = {f.name: f.dataType for f in old or ()}
    lower = {n.lower(): n for n in out}
    for f in new:
        held = lower.setdefault(f.name.lower(), f.name)
        if held != f.name or out.setdefault(f.name, f.dataType).simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} {f.dataType.simpleString()} contradicts {held} {out[held].simpleString()}")
    return StructType([StructField(n, t, True) for n, t in out.items()])


class ShardStore:
    """Shards and manifests below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.folder, self.target, self.fanout = spark, folder.rstrip("/"), target, fanout
        self._fs, self._path = store_of(spark, self.folder)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in names_in(self.spark, f"{self.folder}/manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{version, shards: [{file, bytes}], schema} of a version, the newest by default."""
        found = [version] if version else self.versions()
        if not found:
            return {"version": 0, "shards": [], "schema": None}
        return json.loads(file_text(self.spark, f"{self.folder}/manifests/{found[-1]:012d}.json"))

    def _commit(self, last: dict, shards: list[dict], schema: StructType) -> dict | None:
        """The next manifest, or None if another writer has made it."""
        new = {"version": last["version"] + 1, "shards": shards, "schema": schema.json()}
        made = create_once(self.spark, f"{self.folder}/manifests/{new['version']:012d}.json", json.dumps(new).encode())
        return new if made else None

    def _listed(self, name: str) -> list[dict]:
        files = self._fs.listStatus(self._path(f"{self.folder}/{name}"))
        return [{"file": f"{name}/{f.getPath().getName()}", "bytes": f.getLen()} for f in files if f.getPath().getName().endswith(".parquet")]

    def _written(self, df: DataFrame) -> list[dict]:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return self._listed(name)

    def _added(self, shards: list[dict], schema: StructType) -> dict:
        while True:
            last = self.manifest()
            done = self._commit(last, last["shards"] + shards, merged_schema(self._schema(last), schema))
            if done:
                return done

    def append(self, df: DataFrame) -> dict:
        """Add an arrival as shards, as many as ``df`` has partitions."""
        merged_schema(self._schema(self.manifest()), df.schema)
        return self._added(self._written(df), df.schema)

    def append_each(self, df: DataFrame, arrival: Column) -> list[dict]:
        """Add the rows of each value of ``arrival`` as an arrival of its own, a version each; ``df`` is read once."""
        merged_schema(self._schema(self.manifest()), df.schema)
        key, name = "arrival", f"data/{uuid.uuid4().hex}"
        while key.lower() in {c.lower() for c in df.columns}:
            key += "_"
        df.withColumn(key, arrival).write.partitionBy(key).parquet(f"{self.folder}/{name}")
        found = [self._listed(f"{name}/{x}") for x in names_in(self.spark, f"{self.folder}/{name}")]
        return [self._added(x, df.schema) for x in found or [[]]]

    def tiers(self, manifest: dict | None = None) -> dict[int, list[dict]]:
        """Shards below half the target size by tier; tier t holds those of target / fanout**(t + 1) to target / fanout**t bytes."""
        out: dict[int, list[dict]] = {}
        for s in (manifest or self.manifest())["shards"]:
            if s["bytes"] < self.target / 2:
                out.setdefault(int(math.log(self.target / max(s["bytes"], 1), self.fanout)), []).append(s)
        return out

    def due(self, manifest: dict | None = None) -> list[list[dict]]:
        """The runs of small shards that a manifest, the newest by default, leaves to merge."""
        return [x for x in self.tiers(manifest).values() if len(x) >= self.fanout or (len(x) > 1 and sum(s["bytes"] for s in x) >= self.target)]

    def compact(self) -> dict:
        """Merge the runs of every full tier until none is; commits a version for each round that merged any."""
        while True:
            last = self.manifest()
            runs = self.due(last)
            if not runs:
                return last
            gone, made = {s["file"] for run in runs for s in run}, [m for run in runs for m in self._merged(run, last)]
            if len(made) >= len(gone):
                # nothing is won where the session deals files out more finely than they are
                self._drop(made)
                return last
            while gone <= {s["file"] for s in last["shards"]}:
                # shards that came meanwhile stay as they are
                if self._commit(last, [s for s in last["shards"] if s["file"] not in gone] + made, self._schema(last)):
                    break
                last = self.manifest()
            else:
                self._drop(made)

    def _drop(self, made: list[dict]) -> None:
        for folder in {m["file"].rsplit("/", 1)[0] for m in made}:
            remove(self.spark, f"{self.folder}/{folder}")

    def _merged(self, run: list[dict], manifest: dict) -> list[dict]:
        # a session of its own: the packing of files is a setting of the session
        packing = self.spark.newSession()
        for k, v in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            packing.conf.set(f"spark.sql.files.{k}", v)
        rows = packing.read.schema(self._schema(manifest)).parquet(*[f"{self.folder}/{s['file']}" for s in run])
        # packed files fill half of the target at least
        return self._written(rows.coalesce(max(1, math.ceil(2 * sum(s["bytes"] for s in run) / self.target))))

    @staticmethod
    def _schema(manifest: dict) -> StructType | None:
        return StructType.fromJson(json.loads(manifest["schema"])) if manifest["schema"] else None

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("nothing was appended yet")
        if not m["shards"]:
            return self.spark.createDataFrame([], self._schema(m))
        return self.spark.read.schema(self._schema(m)).parquet(*[f"{self.folder}/{s['file']}" for s in m["shards"]])

    def vacuum(self) -> int:
        """Delete shards that the newest manifest doesn't name; returns their number. For use when no older version is read and nothing is being written."""
        held, n = {s["file"] for s in self.manifest()["shards"]}, 0

        def clear(folder: str) -> None:
            nonlocal n
            for name in names_in(self.spark, f"{self.folder}/{folder}"):
                at = f"{folder}/{name}"
                if self._fs.getFileStatus(self._path(f"{self.folder}/{at}")).isDirectory():
                    clear(at)
                elif name.endswith(".parquet") and at not in held:
                    self._fs.delete(self._path(f"{self.folder}/{at}"), False)
                    n += 1

        clear("data")
        return n
