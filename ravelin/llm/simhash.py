"""SimHash near-duplicates by tables of distances to pivots.

1. One scan gives each text its fingerprint: XXH64 (seed 42) of every word shingle, repeats included; a bit is 1 if
   more than half of the hashes have it. Equal fingerprints are one class, held by its smallest doc_id.
2. Each class's distances to PIVOTS fixed reference fingerprints are computed once. Two fingerprints within d bits
   differ by at most d in every such coordinate.
3. Fingerprints within d bits agree in one of d + 1 pieces of their bits, so a class goes to d + 1 buckets, by the value
   of each piece. A bucket of more than BUCKET classes isn't compared but cut by the same rule: its classes differ
   in the other bits only, which make d + 1 pieces again. After few rounds that leaves no bits to differ in, so every
   bucket ends up bounded, and no pair is lost.
4. Inside a bucket classes are sorted by their first coordinate and compared while that differs by at most d; a pair goes on if its
   greatest coordinate difference is at most d, and is verified by its differing bits. Classes that are linked already
   aren't compared; a bucket gives at most one link a class, so pairs never become rows.
5. Components of the links give the groups.

Defined cases: a null, empty or wordless text has fingerprint zero, linked like any other; fewer words than a
shingle count as one; rows that share a doc_id are nodes of their own, each with its fingerprint; a null doc_id gets its
fingerprint, is linked with nothing and has a null component; an empty table gives an empty one; other columns
are not read. Texts are hashed in pieces of PIECE bytes, so a very long one needs no more memory than it has itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ravelin.llm import _words as W
from ravelin.llm._graph import components, unite
from ravelin.llm._store import remove, saved, shared_dir, text_steps

#: Reference fingerprints, and the seed they come from.
PIVOTS, PIVOT_SEED = 24, 51
#: Most classes that one bucket is compared with.
BUCKET = 4096
#: Bytes of text whose words are held at a time.
PIECE = 1 << 20
SEED = 42


def _word_lists(text: bytes, k: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces, each after the last k - 1 words before it."""
    at, held = 0, []
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        held = held[max(0, len(held) - k + 1) :] + text[at:end].lower().split()
        at = end
        yield held


def fingerprint(text: bytes, k: int = 3) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; bytes.lower and bytes.split know the ASCII letters and white space only."""
    ones, total, few = np.zeros(64, np.int64), 0, []
    for words in _word_lists(text, k):
        if len(words) < k:
            few = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate((len(w) + 1 for w in words), initial=0))
        h = np.array([xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(ends, ends[k:])], np.uint64)
        total += len(h)
        for i in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return xxh64_intdigest(b" ".join(few), SEED) if few else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_steps(batch):
                fp = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivot_distances(fp: Column) -> Column:
    """Differing bits from each pivot."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("tinyint") for p in W.keys(PIVOTS, PIVOT_SEED).view(np.int64)])


def finer(mask: int, distance: int) -> list[int]:
    """The masks that add one piece of the bits outside of ``mask``; fingerprints that agree in ``mask`` and differ in at most ``distance`` bits agree in one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucketed(rows: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Each row once for every finer mask of its own, with the bits it has there."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(_signed(m), _signed(x)) for m in masks for x in finer(m, distance)], "mask long, finer long")
    out = rows.join(F.broadcast(table), "mask").drop("mask").withColumnRenamed("finer", "mask")
    return out.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _near(distance: int):
    """Links of rows that come by bucket (mask, value) and first coordinate; a bucket is bounded and held whole."""

    def link(t: pa.Table) -> pa.RecordBatch:
        mask, value, fp = (t.column(c).to_numpy() for c in ("mask", "value", "fp"))
        piv = t.column("pivots").combine_chunks().flatten().to_numpy().reshape(len(fp), -1).astype(np.int16)
        bits, first = fp.view(np.uint64), piv[:, 0]
        n = len(fp)
        root, on, s = np.arange(n), np.arange(n), 1
        while True:
            # rows are sorted, so a row that is past its bucket or too far in the first coordinate stays so
            on = on[on < n - s]
            on = on[(mask[on + s] == mask[on]) & (value[on + s] == value[on]) & (first[on + s] - first[on] <= distance)]
            if not len(on):
                break
            i = on[root[on] != root[on + s]]
            for c in range(1, piv.shape[1], 4):
                i = i[(np.abs(piv[i + s, c : c + 4] - piv[i, c : c + 4]) <= distance).all(axis=1)]
            i = i[np.bitwise_count(bits[i + s] ^ bits[i]) <= distance]
            if len(i):
                root = unite(root, i, i + s)
            s += 1
        out = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[root[out]]), pa.array(fp[out])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            begins = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
            cut = int(begins[-1]) + 1 if len(begins) else 0
            own = held and held[-1].column(0)[-1].as_py() == mask[0] and held[-1].column(1)[-1].as_py() == value[0]
            if held and (cut or not own):  # what is held is whole with this batch's rows before the cut
                yield link(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield link(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield link(pa.Table.from_batches(held))

    return run


def links(classes: DataFrame, folder: str, distance: int = 3, bucket: int = 0) -> DataFrame:
    """Fingerprints (a, b) that join all classes (fp, pivots) within ``distance`` bits, directly or by others that are."""
    # more classes than 2 ** distance differ in more bits than distance, so there is one for each piece
    most, level, masks, found = max(bucket or BUCKET, 1 << distance), 0, [0], []
    rows = classes.select("fp", "pivots", F.lit(0).cast("long").alias("mask"))
    while True:
        rows = _bucketed(rows, masks, distance)
        large = saved(rows.groupBy("mask", "value").count().where(F.col("count") > most).drop("count"), folder, f"large-{level}")
        masks = [r.mask % (1 << 64) for r in large.select("mask").distinct().collect()]  # 4 ** level at most
        more = bool(masks)
        small = rows.join(large, ["mask", "value"], "left_anti") if more else rows
        small = small.select("mask", "value", "fp", "pivots").repartition("mask", "value").sortWithinPartitions("mask", "value", F.col("pivots")[0], "fp")
        found.append(saved(small.mapInArrow(_near(distance), "a long, b long"), folder, f"links-{level}"))
        if not more:
            break
        rows = saved(rows.join(large, ["mask", "value"], "left_semi").drop("value"), folder, f"rest-{level}")
        level += 1
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def groups(docs: DataFrame, k: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", bucket: int = 0) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links, itself included)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    prints = saved(fingerprints(docs, k, id_col, text_col), folder, "prints")
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = saved(classes.withColumn("pivots", pivot_distances(F.col("fp"))), folder, "classes")
    found = components(links(classes, folder, distance, bucket), folder, "components").withColumnRenamed("node", "fp")
    named = classes.select("fp", "rep").join(found, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("label"))
    named = saved(named, folder, "named")
    named = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("fp", "component_id")
    # a fingerprint that a third of all rows share is split by Spark's skew join
    out = prints.join(named, "fp", "left")
    out = out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    remove(spark, f"{folder}/components-0")
    return out


def drop_duplicates(docs: DataFrame, k: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest doc_id; rows without one stay."""
    gone = groups(docs, k, distance, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
