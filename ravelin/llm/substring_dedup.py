"""Substring dedup with fixed-block anchors.

A word is removed if it lies in a window of n words whose sequence also starts elsewhere, in
another document or the same one. Any such window, of whatever document, contains a whole block
of k = (n + 1) // 2 words that starts at a multiple of k in its document, and that block's words
occur at the other place too, at any offset. So:

1. One scan digests each text's word sequence. Texts with the same sequence are one class; if
   two rows or more share one, every window of theirs repeats. One row stands for its class below.
2. A sieve spares the rest of the corpus the probing: of each n - k + 1 successive k-word
   hashes the least is sent on (equal windows send the same one), and texts in which no sent
   hash repeats hold no repeat. Around those that repeat lie the regions that are looked at.
   Successive sent hashes of a text that are equal (a word repeated) are one row.
3. Non-overlapping reference blocks of the regions are indexed by hash and probed with every
   rolling k-word window of the regions, counted by hash before the shuffle.
4. Hits are extended: the n-word windows that contain a block found elsewhere are counted by a
   128-bit hash; those that occur twice or more, joined where they overlap, are the maximal
   repeats. Places of one window that follow each other (a word repeated) are one row with a count.
5. The ranges found go back to their texts.

No pairs are made: each step counts hashes, so a passage that very many texts share costs its
number of places. What a sample of the rows shows twice is known to repeat; the most frequent of it
are salted, so that no task gets all rows of a hash, and every other hash is counted in one task. Texts are never shuffled while the ids of those to be looked at pass a check of
their number and are broadcast; beyond, they are joined by a shuffle.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing;
repeated rows repeat each other; rows that share a doc_id are told apart by their text; a null
doc_id is treated as a doc_id of its own; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import _words as W
from ravelin.llm._graph import beside_group, beside_rows
from ravelin.llm._store import remove, saved, shared_dir, text_steps

#: Most texts whose ids and ranges are sent to all executors; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000
#: Share of rows sampled for frequent hashes, how many of those are salted at most, and over how many salts.
SAMPLED, FREQUENT, SALTS = 0.02, 1000, 1024
ROW = "doc_id long, tag int"


def _tags(words: W.Words, h: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """128-bit digest of each text's word sequence, and its first 32 bits."""
    digests = [hashlib.blake2b(h[i:j].tobytes(), digest_size=16).digest() for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
    return digests, np.frombuffer(b"".join(digests), np.int32)[::4]


def _inside(words: W.Words, k: int) -> np.ndarray:
    """For each place of a k-word window of the joined texts, whether it stays in one text."""
    doc = words.doc
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def _sieved(r: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """Places of the least of each ``span`` successive hashes of one text, ascending."""
    if len(r) < span:
        return np.zeros(0, np.int64)
    x = np.where(ok, r, np.uint64(0xFFFFFFFFFFFFFFFF))
    views = np.lib.stride_tricks.sliding_window_view(x, span)
    whole = np.flatnonzero(ok[: len(views)] & ok[span - 1 :])
    # a span lies in one text if its first and last windows do and no text ends between
    whole = whole[np.lib.stride_tricks.sliding_window_view(ok, span).all(axis=1)[whole]]
    return np.unique(whole + views[whole].argmin(axis=1))


def _scan(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, tag, n_words, digest, sha (of the words joined by a space), sieve: arrays of hashes, places and runs (places from the first to the last of equal hashes in succession)."""
    schema = f"{ROW}, n_words long, digest binary, sha string, hashes array<long>, places array<int>, runs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_steps(batch):
                words = W.split(texts)
                h = W.hashes(words)
                digests, tag = _tags(words, h)
                r = W.rolling(h, k, 5)
                at = _sieved(r, _inside(words, k), n - k + 1)
                edge = np.searchsorted(at, words.first)
                new = np.concatenate([[True], r[at[1:]] != r[at[:-1]]])[: len(at)]
                new[edge[edge < len(at)]] = True
                head = np.flatnonzero(new)
                tail = at[(np.append(head[1:], len(at)) - 1)[: len(head)]]
                at = at[head]
                cut = np.searchsorted(at, words.first)
                begin = np.repeat(words.first[:-1], np.diff(cut))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (r[at].view(np.int64), (at - begin).astype(np.int32), (tail - at + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(tag), pa.array(np.diff(words.first)), pa.array(digests, pa.binary()), pa.array([_sha(t) for t in texts]), *lists],
                    names=["doc_id", "tag", "n_words", "digest", "sha", "hashes", "places", "runs"],
                )

    return docs.mapInArrow(run, schema)


def _sha(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _joined_ranges(rows: DataFrame, before: int, length: int) -> DataFrame:
    """doc_id, tag, starts, ends: the union of [p - before, p - before + length + run - 1) over the lists ``places`` and ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for places, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                order = np.argsort(p := np.array(places, np.int64), kind="stable")
                s, e = np.maximum(p[order] - before, 0), np.maximum.accumulate((p + np.array(runs, np.int64))[order] + (length - before - 1))
                new = np.flatnonzero(s[1:] > e[:-1]) + 1
                starts.append(s[np.concatenate([[0], new])])
                ends.append(e[np.concatenate([new - 1, [len(e) - 1]])])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "tag", "starts", "ends"])

    return rows.select("doc_id", "tag", "places", "runs").mapInArrow(run, f"{ROW}, starts array<int>, ends array<int>")


def _regions(texts: DataFrame) -> DataFrame:
    """Word hashes of the parts of each text that lie within reach of a repeated sieve hash: doc_id, tag, at, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            for i, j, part in text_steps(batch):
                words = W.split(part)
                h = W.hashes(words)
                tag = _tags(words, h)[1]
                ids, tags, ats, out = [], [], [], []
                for d in range(j - i):
                    first, last = int(words.first[d]), int(words.first[d + 1])
                    if int(tag[d]) != batch.column(4)[i + d].as_py():
                        continue
                    for s, e in zip(*marks[i + d]):
                        e = min(e, last - first)
                        ids.append(batch.column(0)[i + d].as_py())
                        tags.append(int(tag[d]))
                        ats.append(s)
                        out.append(h[first + s : first + e].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(ats, pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "tag", "at", "words"])

    return texts.select("doc_id", F.col("text").cast("binary").alias("text"), "starts", "ends", "tag").mapInArrow(run, f"{ROW}, at int, words binary")


def _probes(regions: DataFrame, k: int) -> DataFrame:
    """(hash, n): how often each k-word hash occurs in the regions of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                h = [W.rolling(np.frombuffer(x, np.uint64), k, 5) for x in batch.column(3).slice(i, 2048).to_pylist()]
                v, c = np.unique(np.concatenate(h), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], names=["hash", "n"])

    return regions.mapInArrow(run, "hash long, n long")


def _blocks(regions: DataFrame, k: int) -> DataFrame:
    """(hash, doc_id, tag, at, block): the non-overlapping blocks of each region, by their hash; at tells the region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, rows, blocks = [], [], []
            for row, (at, x) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                r = W.rolling(np.frombuffer(x, np.uint64), k, 5)
                own = np.arange(-at % k, len(r), k)
                hs.append(r[own])
                rows.append(np.full(len(own), row))
                blocks.append(own + at)
            if not hs:
                continue
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hs).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(np.concatenate(blocks).astype(np.int32))],
                names=["hash", "doc_id", "tag", "at", "block"],
            )

    return regions.mapInArrow(run, f"hash long, {ROW}, at int, block int")


def _windows(regions: DataFrame, n: int, k: int) -> DataFrame:
    """(high, low, doc_id, tag, place, run): n-word windows that hold a block found elsewhere; equal ones in succession are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], []]
            for row, (at, x, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                w = np.frombuffer(x, np.uint64)
                a, b = W.rolling(w, n, 6), W.rolling(w, n, 7)
                if not len(a):
                    continue
                f = np.unique(np.array(found, np.int64)) - at
                mark = np.zeros(len(a) + n + 1, np.int64)
                np.add.at(mark, np.clip(f - (n - k), 0, len(a)), 1)
                np.add.at(mark, np.clip(f + 1, 0, len(a)), -1)
                on = np.flatnonzero(np.cumsum(mark)[: len(a)] > 0)
                if not len(on):
                    continue
                same = np.concatenate([[False], (np.diff(on) == 1) & (a[on[1:]] == a[on[:-1]]) & (b[on[1:]] == b[on[:-1]])])
                head = np.flatnonzero(~same)
                run_ = np.diff(np.append(head, len(on)))
                for c, v in zip(cols, (a[on[head]], b[on[head]], np.full(len(head), row), on[head] + at, run_)):
                    c.append(v)
            if cols[0]:
                a, b, rows, place, runs = map(np.concatenate, cols)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(place.astype(np.int32)), pa.array(runs.astype(np.int32))],
                    names=["high", "low", "doc_id", "tag", "place", "run"],
                )

    return regions.mapInArrow(run, f"high long, low long, {ROW}, place int, run int")


def _kept(texts: DataFrame) -> DataFrame:
    """doc_id, tag, n_removed, kept_sha256 of texts without the words of their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j, part in text_steps(batch):
                words = W.split(part)
                tag = _tags(words, W.hashes(words))[1]
                take, removed, shas = [], [], []
                for d, text in enumerate(part):
                    if int(tag[d]) != batch.column(4)[i + d].as_py():
                        continue
                    own = text.split()
                    count = len(own)
                    for s, e in zip(reversed(starts[i + d]), reversed(ends[i + d])):
                        del own[s:e]
                    take.append(i + d)
                    removed.append(count - len(own))
                    shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
                take = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(4).take(take), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "tag", "n_removed", "kept_sha256"])

    return texts.select("doc_id", F.col("text").cast("binary").alias("text"), "starts", "ends", "tag").mapInArrow(run, f"{ROW}, n_removed long, kept_sha256 string")


def _beside(docs: DataFrame, rows: DataFrame, payload: int) -> DataFrame:
    """Texts beside the rows of the same doc_id; ``rows`` is a written table with ``payload`` numbers in its lists."""
    small = rows.count() <= BROADCAST_TEXTS and payload <= 20 * BROADCAST_TEXTS
    rows = rows.withColumnRenamed("doc_id", "of")
    return docs.join(F.broadcast(rows) if small else rows, F.col("doc_id").eqNullSafe(F.col("of")))


def _frequent(sample: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent of the keys that a sample of rows holds twice or more; at most FREQUENT rows."""
    counts = sample.groupBy(*keys).agg(F.sum("run").alias("n")).where("n > 1")
    return counts.orderBy(F.desc("n"), *keys).limit(FREQUENT).select(*keys)


def _repeating(rows: DataFrame, frequent: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, tag, places, runs: the places whose key occurs twice or more. Those of ``frequent`` do, and are dealt out by a salt."""
    known = F.broadcast(frequent.withColumn("known", F.lit(True)))
    salt = F.when(F.col("known"), 1 + F.pmod(F.xxhash64("doc_id", "tag", "place"), F.lit(SALTS))).otherwise(0).cast("int")
    # dealt out once, for the count and for what it is joined to
    dealt = rows.join(known, keys, "left").select("doc_id", "tag", *keys, "place", "run", salt.alias("salt")).repartition(*keys, "salt")
    again = dealt.groupBy(*keys, "salt").agg(F.sum("run").alias("n")).where("n > 1 or salt > 0").select(*keys, "salt")
    found = dealt.join(again, [*keys, "salt"], "left_semi").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("place", "run")).alias("p"))
    return found.select("doc_id", "tag", F.col("p.place").alias("places"), F.col("p.run").alias("runs"))


def remove_repeats(docs: DataFrame, n: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by a space)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    k = (n + 1) // 2
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    scanned = saved(_scan(docs.select("doc_id", F.col("text").cast("binary").alias("text")), n, k), folder, "scan")
    # rows of one word sequence are a class; the least of them (a null doc_id sorts first) stands for it
    facts = scanned.select("doc_id", "tag", "n_words", "digest", "sha", F.struct("doc_id", "tag").alias("at"), F.lit(1).alias("one"))
    long = beside_group(facts.where(F.col("n_words") >= n), ["digest"], ["doc_id", "tag", F.monotonically_increasing_id()], copies=("sum", "one"), rep=("min", "at"))
    facts = facts.where(F.col("n_words") < n).select("doc_id", "tag", "n_words", "sha", F.lit(1).cast("long").alias("copies"), F.lit(True).alias("stands")).union(
        long.select("doc_id", "tag", "n_words", "sha", "copies", F.col("at").eqNullSafe(F.col("rep")).alias("stands"))
    )
    facts = saved(facts, folder, "facts")
    # every other row of a class is left out of what follows
    copies = saved(facts.where("not stands").select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag")).distinct(), folder, "copies")
    small = copies.count() <= BROADCAST_TEXTS
    first = scanned.where(F.col("n_words") >= n).join(F.broadcast(copies) if small else copies, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left_anti")
    first = first.select("doc_id", "tag", F.explode(F.arrays_zip("hashes", "places", "runs")).alias("s"))
    first = first.select("doc_id", "tag", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"), F.col("s.runs").alias("run"))
    frequent = saved(_frequent(first.sample(SAMPLED, seed=7), ["hash"]), folder, "frequent-hashes")
    # a window that holds the k words at p starts in [p - (n - k), p]
    marked = saved(_joined_ranges(_repeating(first, frequent, ["hash"]), n - k, 2 * n - k), folder, "marked")
    payload = marked.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]

    regions = saved(_regions(_beside(docs, marked, payload)), folder, "regions")
    counts = _probes(regions, k).groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    hit = beside_rows(_blocks(regions, k), ["hash"], ["doc_id", "tag", "at", "block"], counts, "left_semi").groupBy("doc_id", "tag", "at").agg(F.collect_list("block").alias("found"))
    same = regions["doc_id"].eqNullSafe(F.col("h_doc")) & (regions["tag"] == F.col("h_tag")) & (regions["at"] == F.col("h_at"))
    held = regions.join(hit.withColumnsRenamed({"doc_id": "h_doc", "tag": "h_tag", "at": "h_at"}), same).select("doc_id", "tag", "at", "words", "found")
    # every window of the sampled regions, as a block every n - k + 1 words lies in each
    everywhere = F.sequence("at", F.col("at") + (F.octet_length("words") / 8).cast("int"), F.lit(n - k + 1))
    sampled = _windows(regions.sample(SAMPLED, seed=7).withColumn("found", everywhere), n, k)
    frequent = saved(_frequent(sampled, ["high", "low"]), folder, "frequent-windows")
    repeats = saved(_joined_ranges(_repeating(_windows(held, n, k), frequent, ["high", "low"]), 0, n), folder, "repeats")
    for x in ("regions", "marked"):
        remove(spark, f"{folder}/{x}")
    payload = repeats.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]

    partly = _kept(_beside(docs, repeats, payload)).distinct().withColumnsRenamed({"doc_id": "of", "tag": "of_tag"})
    # rows of which nothing is removed in part meet no join, so none gathers those without words or id
    copied = F.col("copies") > 1
    some = facts.where(~copied & (F.col("n_words") >= n))
    out = some.join(partly, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    rest = facts.where(copied | (F.col("n_words") < n))
    out = out.select("doc_id", "n_words", "copies", "n_removed", "kept_sha256", "sha").union(rest.select("doc_id", "n_words", "copies", F.lit(0).cast("long"), F.lit(None).cast("string"), "sha"))
    return out.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
