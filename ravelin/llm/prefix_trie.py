"""The trie of conversation prefixes by preorder intervals.

1. Each conversation becomes the sequence of its turns' digests (role and text) and word counts, 20 bytes a turn; texts go no
   further. Conversations are rebuilt from such sequences: the first h turns of the conversation that opens their
   family, then their own after the first h.
2. Equal sequences are one path with its number of members. Paths are ranked in lexicographic order by a sort over ranges.
   A node's members then have consecutive ranks: its interval [left, right].
3. Each task reads its paths in that order with a stack of open nodes, so a prefix that many paths share leaves the task as one
   row; rows of one node are merged by its digest.
4. Nodes sorted by (left, depth) are in preorder. Distributed prefix sums give each its place and how many leaves and saved tokens come
   before it; its subtree ends with the last node that begins at ``right``, and the difference of the two sums is what the subtree holds.

The members that end at a node are hashed in a stream, sorted by id: SHA-256 is sequential by definition, so the ids of one
node pass through one task, 8 bytes each, none of them held.

Defined cases: rows without conv_id belong to no conversation; turns are ordered by turn (null first), equal turns by digest;
null role or text is empty; repeated rows are turns of their own; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm._native import words
from ravelin.llm._ranks import running
from ravelin.llm._store import saved, shared_dir

#: Conversations of one family, which opens with the first of them, and the lengths that a rebuilt head can have.
FAMILY, HEADS = 20, 4
_TURNS = "array<struct<key:binary,n_words:int>>"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (key, n_words) in order; key is a digest of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"), key.alias("key"), F.size(words(text)).alias("n_words"))
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["n_words"].alias("n_words"))).cast(_TURNS).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, path and path_id (a digest of the path) of each conversation: the first h turns of its family's first one, then its own after the first h; h = crc32(conv_id) % 4."""
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    both = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left").withColumn("h", h)
    head = F.coalesce("head", F.array().cast(_TURNS))
    path = F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    out = both.select("conv_id", path.alias("path"))
    return out.withColumn("path_id", F.md5(F.array_join(F.transform("path", lambda x: F.hex(x["key"])), "")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path_id, conv_id) come sorted: path_id and the SHA-256 of its ids, joined by commas."""
    of, held = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if path != of:
                if held:
                    done.append((of, held.hexdigest()))
                of, held = path, hashlib.sha256(str(conv).encode())
            else:
                held.update(f",{conv}".encode())
        yield pa.RecordBatch.from_pydict({"ends": pa.array([x for x, _ in done], pa.string()), "ends_sha256": pa.array([x for _, x in done], pa.string())})
    if held:
        yield pa.RecordBatch.from_pydict({"ends": [of], "ends_sha256": [held.hexdigest()]})


_NODE = {"node": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "last_words": pa.int64(), "left": pa.int64(), "right": pa.int64(), "n_convs": pa.int64(), "conv_id": pa.int64(), "ends": pa.string()}


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rank, path, path_id, n, conv_id) come by rank: each node of the task's paths once, with its interval, members and smallest member among them."""
    root = b"\0" * 16
    stack: list[list] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            if stack:  # what a node has counts for the node above it
                up = stack[-1]
                up[5], up[6], up[7] = max(up[5], x[5]), up[6] + x[6], min(up[7], x[7])
            out.append(x)

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * len(_NODE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _NODE.values())], names=list(_NODE))

    out: list[list] = []
    before: list[bytes] = []
    for batch in batches:
        lists = batch.column(1)
        keys, sizes = lists.flatten().field(0).to_pylist(), lists.flatten().field(1).to_pylist()
        at = 0
        for rank, n_turns, path_id, n, conv in zip(batch.column(0).to_pylist(), lists.value_lengths().to_pylist(), *(batch.column(c).to_pylist() for c in (2, 3, 4))):
            path = keys[at : at + n_turns]
            same = next((i for i, (x, y) in enumerate(zip(path, before)) if x != y), min(len(path), len(before)))
            if not stack:
                stack.append([root, None, 0, 0, rank, rank, 0, conv, None])
            close(same + 1)
            for d in range(same, n_turns):
                up = stack[-1][0]
                stack.append([hashlib.blake2b(up + path[d], digest_size=16).digest(), up, d + 1, sizes[at + d], rank, rank, 0, conv, None])
            top = stack[-1]
            top[5], top[6], top[7], top[8] = rank, top[6] + n, min(top[7], conv), path_id
            before, at = path, at + n_turns
        yield rows()
        out = []
    close(0)
    yield rows()


def trie(conversations: DataFrame) -> DataFrame:
    """Per node, the root included: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    folder = shared_dir(spark)
    own = saved(sequences(conversations), folder, "own")
    convs = saved(rebuilt(own), folder, "rebuilt")
    ends = convs.select("path_id", "conv_id").repartition("path_id").sortWithinPartitions("path_id", "conv_id").mapInArrow(_digests, "ends string, ends_sha256 string")

    paths = convs.groupBy("path_id").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    ranked = running(paths.withColumn("keys", F.col("path.key")), ["keys"], folder, "paths").select(F.col("pos").alias("rank"), "path", "path_id", "n", "conv_id")
    seen = ranked.sortWithinPartitions("rank").mapInArrow(_opened, "node binary, parent binary, depth long, last_words long, `left` long, `right` long, n_convs long, conv_id long, ends string")
    one = lambda f, *cs: [f(c).alias(c) for c in cs]
    nodes = seen.groupBy("node").agg(*one(F.first, "parent", "depth", "last_words"), *one(F.min, "left", "conv_id"), *one(F.max, "right", "ends"), *one(F.sum, "n_convs"))
    nodes = saved(nodes, folder, "nodes")

    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    family = saved(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), folder, "family")
    # a node of very many children is split by Spark's skew join
    named = family.join(family.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    leaf, gain = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("last_words")
    placed = running(named.drop("parent", "node").withColumns({"leaf": leaf, "gain": gain}), ["left", "depth"], folder, "preorder", ("leaf", "gain"))
    last = placed.groupBy(F.col("left").alias("right")).agg(F.max(F.col("before_leaf") + F.col("leaf")).alias("leaves"), F.max(F.col("before_gain") + F.col("gain")).alias("gains"), (F.max("pos") + 1).alias("end"))
    out = placed.join(last, "right").join(ends, "ends", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") - F.col("before_leaf")).alias("n_leaves"),
        (F.col("gains") - F.col("before_gain")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), F.col("pos").alias("preorder"), F.col("end").alias("subtree_end"),
    )
