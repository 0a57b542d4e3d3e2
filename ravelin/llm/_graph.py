"""Connected components of a table of links, and joins that leave no key to one task.

Links are united in chunks of a bounded number, each in the memory of one task. What a chunk comes to is a
star: its least node and every other one. Where all stars together fit one chunk, one more task ends the work.
Else the stars meet by their outer node, so a node of very many links is spread over its neighbours, and each
node hangs below one of its centres. Nodes that nothing hangs below are set aside, the others and the links
between centres are the next level's, and at the end each node gets the component of what it hangs below. The
order of nodes is a hash that changes with the level, so long chains shrink by a share at each.
Levels are written to the shared folder, as a cut in lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import _words as W
from ravelin.llm._store import remove, saved

#: Links that one task unites in memory at a time.
CHUNK = 1_000_000
#: Tasks that the rows of one key are dealt to.
SALTS = 256


def beside_group(rows: DataFrame, keys: list[str], by: list[str], **made: tuple[str, str]) -> DataFrame:
    """``rows`` with aggregates over their key as further columns: name=(min, max or sum, column).

    Rows are dealt by key and a salt from the columns ``by``, so no task gets all rows of a key; the groups
    of a key meet as one row a salt, and what they come to goes back to each salt that is there. Null keys go.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).repartition(*keys, "salt")
    over = lambda name, column, to: getattr(F, name)(column).alias(to)
    part = dealt.groupBy(*keys, "salt").agg(*[over(f, c, to) for to, (f, c) in made.items()])
    whole = part.groupBy(*keys).agg(*[over(f, to, to) for to, (f, _) in made.items()], F.collect_set("salt").alias("salts"))
    spread = whole.select(*keys, *made, F.explode("salts").alias("salt"))
    return dealt.join(spread, [*keys, "salt"]).drop("salt")


def beside_rows(rows: DataFrame, keys: list[str], by: list[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left_semi) to the rows of a table with the same key, where no task gets all rows of a key: dealt as in beside_group, and what the table has for a key goes to each salt that is there."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).repartition(*keys, "salt")
    have = dealt.select(*keys, "salt").distinct().join(table, keys, how)
    return dealt.join(have, [*keys, "salt"], how).drop("salt")


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of items 0 to n - 1 after the pairs (a, b) are united; a root is the least item of its group."""
    while True:
        x, y = root[a], root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return root
        a, b = a[apart], b[apart]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def stars(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(centre, node) for each node of the links but the centres; a centre comes first in its group in the level's order (-1: by id)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if level >= 0:
        order = np.argsort(W.mix(nodes.view(np.uint64) ^ W.keys(1, 40 + level)[0]), kind="stable")
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        nodes, at = nodes[order], place[at]
    root = unite(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    out = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[out]], nodes[out]


def _united(level: int, chunk: int, whole: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stars of each ``chunk`` of a task's links (a, b); of all of them, and the centres with themselves, if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
            centre, node = stars(a, b, level)
            if whole:
                top = np.unique(centre)
                centre, node = np.concatenate([centre, top]), np.concatenate([node, top])
            return pa.RecordBatch.from_arrays([pa.array(centre), pa.array(node)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if not whole and sum(x.num_rows for x in held) >= chunk:
                yield out()
                held = []
        if held:
            yield out()

    return run


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) come by b: the first centre of a node is what it hangs below (link: false), each further one is linked with that."""
    last = None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.concatenate([[last is None or b[0] != last[1]], b[1:] != b[:-1]]) if len(b) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
        first = np.where(begin >= 0, a[begin], last[0] if last else 0)
        if len(b):
            last = (first[-1], b[-1])
        keep = np.flatnonzero(new | (first != a))
        yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(np.where(new, b, a)[keep]), pa.array(~new[keep])], names=["a", "b", "link"])


def components(links: DataFrame, folder: str, name: str, chunk: int = 0) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable. Null ends are left out."""
    chunk, level, aside, pair = chunk or CHUNK, 0, [], "a long, b long"
    ends = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    e = saved(ends.mapInArrow(_united(level, chunk), pair), folder, f"{name}-0")
    while e.count() > chunk:
        by = e.repartition("b").sortWithinPartitions("b", F.xxhash64("a", F.lit(level)), "a")
        hung = saved(by.mapInArrow(_hung, f"{pair}, link boolean"), folder, f"{name}-hung-{level}")
        below, between = hung.where("not link").drop("link"), hung.where("link").drop("link")
        held = below.select("a").union(between.select("a")).union(between.select("b")).distinct().select(F.col("a").alias("b"), F.lit(True).alias("held"))
        split = saved(below.join(held, "b", "left").select("a", "b", F.coalesce("held", F.lit(False)).alias("held")), folder, f"{name}-split-{level}")
        aside.append(split.where("not held").drop("held"))
        level += 1
        rest = split.where("held").drop("held").union(between).where("a <> b")
        e = saved(rest.mapInArrow(_united(level, chunk), pair), folder, f"{name}-{level}")
        remove(e.sparkSession, f"{folder}/{name}-hung-{level - 1}")
        remove(e.sparkSession, f"{folder}/{name}-{level - 1}")
    found = saved(e.coalesce(1).mapInArrow(_united(-1, chunk, whole=True), pair), folder, f"{name}-last")
    found = found.select(F.col("b").alias("node"), F.col("a").alias("label"))
    if not aside:
        return found.withColumnRenamed("label", "component")
    for part in reversed(aside):
        # a centre without a label of its own is alone above what hangs below it
        to = part.join(found.select(F.col("node").alias("a"), "label"), "a", "left").select(F.col("b").alias("node"), F.coalesce("label", "a").alias("label"))
        found = found.union(to)
    found = saved(found, folder, f"{name}-labels")
    least = found.groupBy("label").agg(F.least(F.min("node"), F.first("label")).alias("component"))
    out = found.where("node <> label").join(least, "label").select("node", "component")
    return out.union(least.select(F.col("label").alias("node"), "component"))
