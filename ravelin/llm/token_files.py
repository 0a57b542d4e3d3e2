"""Token ids as flat unsigned integer files with 64-bit document offsets.

A data set is a folder of parts in ascending document order. A part is three files:
``part-k-m.bin`` (ids, little-endian, 2 or 4 bytes each as ``meta.json`` says), ``part-k-m.idx``
(n + 1 unsigned 64-bit offsets into the part, in ids) and ``part-k-m.doc`` (n signed 64-bit
document ids). Task k writes its range of documents as parts m = 0, 1, ...: a part is closed once
it holds ``PART_IDS`` ids, so its size is bounded (by that and one document) whatever a task gets.
``meta.json`` is written last and lists the parts with their number of ids and their base, the
exclusive prefix sum of those numbers; a folder without it is no data set.

Each part is written under a name of its attempt and renamed, so a task that runs twice
leaves one good part, and a part depends on nothing an executor holds.

Defined cases: a null text has only the end id; documents without an id come first, and a part
tells how many of its first documents have none (``nulls``; the file holds 0 for them); rows that
share a document id (or have none) follow each other: in as many tasks as their number asks for,
dealt by a hash of their ids, and there shorter first and then by their ids' bytes; an empty table
gives a data set without parts.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.bpe import encode_ids

#: Ids after which a part is closed.
PART_IDS = 32 << 20
#: Most approximate quantiles of doc_id that one scan returns, and so tasks; a task may write any number of parts.
MAX_CUTS = 50_000


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def mapped(store: pafs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a local or mounted disk, else read."""
    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def cuts_by_id(docs: DataFrame, parts: int, id_col: str = "doc_id") -> tuple[list[int], int]:
    """Ascending ids that divide the rows with an id into about equal parts (an id that fills several parts is named as often), and the number of parts for rows without; reads the id column only."""
    shares = [k / parts for k in range(1, min(parts, MAX_CUTS))] or [0.5]
    key = F.col(id_col).cast("long")
    found, rows, with_id = docs.select(F.percentile_approx(key, F.array(*map(F.lit, shares)), 100_000), F.count("*"), F.count(key)).first()
    nulls = rows - with_id
    return (sorted(found or []) if parts > 1 else []), -(-nulls * min(parts, MAX_CUTS) // rows) if nulls else 0


def write(encoded: DataFrame, folder: str, kind: str, cuts: list[int], null_parts: int = 1) -> dict:
    """Write rows of (doc_id, n_tokens, ids) as a data set; returns its meta data."""
    own = F.lit(0)
    if cuts:
        # an id's first part is the number of cuts below it; an id that several cuts name has as many parts
        times = Counter(cuts)
        distinct = sorted(times)
        below = [bisect.bisect_left(cuts, c) for c in distinct] + [len(cuts)]
        at = _halving(F.lit(distinct), len(distinct))
        held = F.element_at(F.lit([times[c] for c in distinct]), F.least(at + 1, F.lit(len(distinct))))
        same = F.element_at(F.lit(distinct), F.least(at + 1, F.lit(len(distinct)))) == F.col("doc_id")
        own = F.element_at(F.lit(below), at + 1) + F.when(same & (held > 1), F.pmod(F.xxhash64("ids"), held)).otherwise(0)
    most = PART_IDS
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("ids"), F.lit(max(null_parts, 1)))).otherwise(null_parts + own)
    rows = (
        encoded.select(part.cast("int").alias("part"), "doc_id", "n_tokens", "ids")
        .repartitionById(null_parts + len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "n_tokens", "ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        mark, part, seq, data, done = uuid.uuid4().hex, None, 0, None, []

        def finish():
            data.close()
            for end, x in (("idx", np.array(sizes, "<u8")), ("doc", np.array([d or 0 for d in ids], "<i8"))):
                with store.open_output_stream(f"{base}/.{mark}-{seq}.{end}") as f:
                    f.write(x.tobytes())
            for end in ("bin", "idx", "doc"):
                store.move(f"{base}/.{mark}-{seq}.{end}", f"{base}/part-{part:06d}-{seq:06d}.{end}")
            done.append((part, seq, len(ids), total, sum(d is None for d in ids)))

        for batch in batches:
            for p, d, n, x in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if data is None or p != part or total >= most:
                    if data is not None:
                        finish()
                    seq = seq + 1 if p == part else 0
                    part, sizes, ids, total = p, [0], [], 0
                    data = store.open_output_stream(f"{base}/.{mark}-{seq}.bin")
                data.write(x)
                total += n
                sizes.append(total)
                ids.append(d)
        if data is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.int64()) for k in range(5)], names=["part", "seq", "docs", "ids", "nulls"])

    # one small row a part
    written = sorted(tuple(r) for r in rows.mapInArrow(run, "part long, seq long, docs long, ids long, nulls long").collect())
    bases = np.cumsum([0, *(w[3] for w in written)]).tolist()
    meta = {"type": kind, "parts": [{"part": f"{p:06d}-{m:06d}", "docs": d, "ids": n, "nulls": z, "base": b} for (p, m, d, n, z), b in zip(written, bases)], "ids": bases[-1]}
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/.meta.json") as f:
        f.write(json.dumps(meta).encode())
    store.move(f"{base}/.meta.json", f"{base}/meta.json")
    return meta


def _halving(edges, n: int):
    """Number of ascending edges below doc_id, by binary search."""
    state = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.element_at(edges, F.least(mid + 1, F.lit(n))) < F.col("doc_id"))
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), state, step)["lo"]


def read_meta(folder: str) -> dict:
    store, base = _open(folder)
    with store.open_input_file(f"{base}/meta.json") as f:
        return json.loads(f.read())


def read_document(folder: str, meta: dict, place: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the place-th document of a data set."""
    store, base = _open(folder)
    for p in meta["parts"]:
        if place < p["docs"]:
            name = f"{base}/part-{p['part']}"
            at = mapped(store, f"{name}.idx", "<u8")[place : place + 2]
            doc = None if place < p["nulls"] else int(mapped(store, f"{name}.doc", "<i8")[place])
            return doc, np.array(mapped(store, f"{name}.bin", meta["type"])[int(at[0]) : int(at[1])])
        place -= p["docs"]
    raise IndexError(place)


def read(spark: SparkSession, folder: str, meta: dict) -> DataFrame:
    """Each document of a data set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not meta["parts"]:
        return spark.createDataFrame([], schema)
    kind = meta["type"]
    parts = spark.createDataFrame([(k, p["part"], p["base"], p["nulls"]) for k, p in enumerate(meta["parts"])], "k int, part string, base long, nulls long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for part, base, nulls in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                name = f"{root}/part-{part}"
                at = np.array(mapped(store, f"{name}.idx", "<u8")).astype(np.int64)
                docs, ids = np.array(mapped(store, f"{name}.doc", "<i8")), mapped(store, f"{name}.bin", kind)
                for i in range(0, len(docs), 10_000):
                    j = min(i + 10_000, len(docs))
                    crc = [zlib.crc32(ids[at[k] : at[k + 1]].astype("<u4").tobytes()) for k in range(i, j)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[i:j], mask=np.arange(i, j) < nulls), pa.array(at[i:j] + base), pa.array(np.diff(at[i : j + 1])), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return parts.repartitionById(len(meta["parts"]), F.col("k")).mapInArrow(run, schema)


def tokens_to_files(docs: DataFrame, folder: str, vocabulary: str, parts: int, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode whole texts and write them as a data set of about ``parts`` parts."""
    from ravelin.llm.bpe import id_type, tokenizer

    kind = id_type(len(tokenizer(vocabulary).bytes_of))
    encoded = encode_ids(docs, vocabulary, id_col, text_col, end_id)
    return write(encoded, folder, kind, *cuts_by_id(docs, parts, id_col))
