"""Hard negatives by maximum inner product over an orthogonally rotated table.

1. Components become integers. The sums of their products over all rows, exact integers added by Spark, give the principal axes, and
   each vector is turned onto them, so the leading components hold most of every product.
2. Anchors are searched against all rows in cells, a bounded block of rows with a bounded block of anchors each, so no task, and
   no driver, holds all of either. Inside a cell the products of the leading components are computed for all pairs at once; the remainder lies
   within the product of the two residual norms (Cauchy and Schwarz) and a slack for rounding. Pairs whose upper bound stays below the
   worst result held, or whose lower bound lies above the range asked for, are discarded; the others add the next components and
   are tested again; what survives is verified by the integer product.
3. A first pass finds each anchor's positives, a second, which knows their scores, the negatives of each. A cell returns its best few
   for each anchor (and positive), and those of all cells are merged by a rank within the anchor.

Defined cases: rows without vec_id, label or vector, or with a null or non-finite component, or one whose integer exceeds MOST in size, take no part; rows that
repeat a vec_id are rows of their own (anchors, positives and negatives each); a shorter vector counts as having zeros after
its end; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm._store import saved, shared_dir

#: Scale of the components, and the largest integer that takes part.
SCALE, MOST = 256, 1 << 26
#: Rows and anchors of one cell.
ROWS_A_CELL, ANCHORS_A_CELL = 32_768, 32_768
#: Pairs whose bounds are in memory at a time.
PAIRS = 1 << 18
#: Pairs whose components are gathered at a time.
GATHERED = 1 << 14


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and q (floor(scale * component)) of the rows that take part."""
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) <= MOST))
    good = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.cast("array<int>").alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The lists of a column as rows of int64, with zeros after the end of short ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def principal_axes(table: DataFrame, dims: int) -> np.ndarray:
    """An orthonormal basis, a column an axis, by falling share of the squared lengths of all rows; from ``dims`` times ``dims`` integer sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(i, 4096), dims).astype(np.float64)
                total += x.T @ x
        rows, cols = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = table.select("q").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    held = np.zeros((dims, dims))
    for x in sums:
        held[x.i, x.j] = x.s
    _, axes = np.linalg.eigh((held + held.T) / 2)
    return axes[:, ::-1].copy()


class Rotated:
    """Vectors on the principal axes: leading parts, residual norms after each of ``steps`` and the integers they come from."""

    def __init__(self, q: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.q = q
        self.y = q.astype(np.float64) @ axes
        self.norm = np.sqrt((self.y**2).sum(axis=1))
        self.rest = [np.sqrt((self.y[:, n:] ** 2).sum(axis=1)) for n in steps]

    def __len__(self) -> int:
        return len(self.q)


def _products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of ``a`` and j of ``x``; where copies are many nearly all pairs of a block come here, so their components are gathered bit by bit."""
    out = np.empty(len(i), a.dtype)
    for k in range(0, len(i), GATHERED):
        at = slice(k, k + GATHERED)
        out[at] = np.einsum("ij,ij->i", a[i[at]], x[j[at]])
    return out


def survivors(a: Rotated, x: Rotated, steps: list[int], most: Callable, least: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that no bound discards, and their integer products. most(bound, i, j) and least(bound, i, j) tell which pairs an upper and a lower bound leave; i and j are None for all pairs at once.

    The slack covers rounding: rotation and sums in 53 bits err by less than 1e-12 of the product of the norms for each of the components.
    """
    slack = 1e-12 * a.y.shape[1] * (np.outer(a.norm, x.norm) + 1)
    part = a.y[:, : steps[0]] @ x.y[:, : steps[0]].T
    rest = np.outer(a.rest[0], x.rest[0]) + slack
    i, j = np.nonzero(most(part + rest, None, None) & least(part - rest, None, None))
    part = part[i, j]
    for n, (begin, end) in enumerate(zip(steps, steps[1:]), 1):
        part = part + _products(a.y[:, begin:end], x.y[:, begin:end], i, j)
        rest = a.rest[n][i] * x.rest[n][j] + slack[i, j]
        keep = np.flatnonzero(most(part + rest, i, j) & least(part - rest, i, j))
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, _products(a.q, x.q, i, j)


def _best(group: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: higher scores first, then smaller vec."""
    order = np.lexsort((vec, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff([*begin, len(g)]))
    return order[rank < k]


def _search(targets: Rotated, owner: np.ndarray, rows: Rotated, vec: np.ndarray, allowed: Callable, low: np.ndarray, high: np.ndarray, k: int, steps: list[int]):
    """For each target (an anchor with a range of scores) the first k allowed rows in that range: target, row, score.

    Targets of one anchor share its products: ``owner`` is the target's anchor. Blocks of rows come one after another, and the k-th score
    held so far is what the next block's upper bounds have to reach.
    """
    t_all, j_all, s_all = (np.zeros(0, np.int64) for _ in range(3))
    floor = low.astype(np.float64).copy()
    step = max(64, PAIRS // max(1, len(targets)))
    first = np.searchsorted(owner, np.arange(len(targets)))
    count = np.searchsorted(owner, np.arange(len(targets)), side="right") - first
    if k < len(rows):
        # the rows with the greatest leading products of the first block: their scores are a first floor
        at = np.arange(min(step, len(rows)))
        lead = np.where(allowed(at), targets.y[:, : steps[0]] @ rows.y[at, : steps[0]].T, -np.inf)
        seed = np.argpartition(lead, -min(k, len(at)), axis=1)[:, -min(k, len(at)) :]
        score = np.einsum("ij,ikj->ik", targets.q, rows.q[seed])
        good = np.isfinite(np.take_along_axis(lead, seed, 1))[owner] & (score[owner] >= low[:, None]) & (score[owner] <= high[:, None])
        floor = np.where(good.all(axis=1) & (seed.shape[1] == k), np.maximum(floor, score[owner].min(axis=1)), floor)
    for b in range(0, len(rows), step):
        at = np.arange(b, min(b + step, len(rows)))
        part = _slice(rows, at)
        # an anchor goes on with what any of its targets may need
        need = np.full(len(targets), np.inf)
        np.minimum.at(need, owner, floor)
        top = np.full(len(targets), -np.inf)
        np.maximum.at(top, owner, high.astype(np.float64))
        free = allowed(at)
        most = lambda u, i, j: u >= (need[:, None] if i is None else need[i])
        least = lambda u, i, j: (u <= top[:, None]) & free if i is None else u <= top[i]
        i, j, s = survivors(targets, part, steps, most, least)
        if not len(i):
            continue
        # pairs by target: those of an anchor, once for each of its targets
        times = count[i]
        t = np.repeat(first[i] - np.cumsum(times) + times, times) + np.arange(times.sum())
        i, j, s = np.repeat(i, times), np.repeat(j, times), np.repeat(s, times)
        on = np.flatnonzero((s >= low[t]) & (s <= high[t]) & (s >= floor[t]))
        t_all, j_all, s_all = (np.concatenate([x, y]) for x, y in ((t_all, t[on]), (j_all, at[j[on]]), (s_all, s[on])))
        keep = _best(t_all, s_all, vec[j_all], k)
        t_all, j_all, s_all = t_all[keep], j_all[keep], s_all[keep]
        full, n = np.unique(t_all, return_counts=True)
        worst = np.full(len(low), np.inf)
        np.minimum.at(worst, t_all, s_all.astype(np.float64))
        floor[full[n == k]] = np.maximum(floor, np.where(np.isinf(worst), floor, worst))[full[n == k]]
    return t_all, j_all, s_all


def _slice(r: Rotated, at: np.ndarray) -> Rotated:
    out = object.__new__(Rotated)
    out.q, out.y, out.norm, out.rest = r.q[at], r.y[at], r.norm[at], [x[at] for x in r.rest]
    return out


def _cells(table: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, rows_a_cell: int, anchors_a_cell: int):
    """Both tables dealt to cells: every row meets every anchor in exactly one."""
    down = max(-(-n_rows // rows_a_cell), min(table.sparkSession.sparkContext.defaultParallelism, -(-n_rows // 1024)), 1)
    over = max(1, -(-n_anchors // anchors_a_cell))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = table.withColumn("d", of("uid", down)).withColumn("o", every(over))
    asked = anchors.select(*[F.col(c).alias(c) for c in anchors.columns]).withColumn("o", of("uid", over)).withColumn("d", every(down))
    return asked.groupBy("d", "o"), rows.groupBy("d", "o")


_FOUND = pa.schema([("uid", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("slot", pa.int64()), ("found_uid", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "uid long, anchor_id long, label long, slot long, found_uid long, found_id long, score long"


def _asker(axes: np.ndarray, steps: list[int], k: int, same: bool):
    """What a cell finds for its anchors (uid, vec_id, label, q, slots of slot, low and high): rows of the same label but themselves, or of different labels."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        order = np.argsort(asked.column("label").to_numpy(), kind="stable")
        asked = asked.take(pa.array(order))
        by = np.argsort(rows.column("label").to_numpy(), kind="stable")
        rows = rows.take(pa.array(by))
        a_uid, a_label = asked.column("uid").to_numpy(), asked.column("label").to_numpy()
        r_uid, r_label, r_vec = (rows.column(c).to_numpy() for c in ("uid", "label", "vec_id"))
        a = Rotated(_matrix(asked.column("q"), len(axes)), axes, steps)
        x = Rotated(_matrix(rows.column("q"), len(axes)), axes, steps)
        slots = asked.column("slots").combine_chunks()
        n_slots = slots.value_lengths().to_numpy()
        slot, low, high = (slots.flatten().field(c).to_numpy() for c in range(3))
        first = np.concatenate([[0], np.cumsum(n_slots)])
        out = []
        # blocks of anchors: of one label where rows of that label are searched, of any number of labels else
        cuts = np.flatnonzero(np.diff(a_label)) + 1 if same else np.zeros(0, np.int64)
        for i, j in zip([0, *cuts], [*cuts, len(a)]):
            near = np.arange(*np.searchsorted(r_label, [a_label[i], a_label[i] + 1])) if same else np.arange(len(x))
            for b in range(i, j, 512):
                e = min(b + 512, j)
                at = np.arange(b, e)
                own = slice(first[b], first[e])
                allowed = (lambda z, at=at, near=near: a_uid[at][:, None] != r_uid[near[z]]) if same else (lambda z, at=at, near=near: a_label[at][:, None] != r_label[near[z]])
                t, z, s = _search(_slice(a, at), np.repeat(np.arange(e - b), n_slots[b:e]), _slice(x, near), r_vec[near], allowed, low[own], high[own], k, steps)
                who = np.repeat(at, n_slots[b:e])[t]
                out.append((a_uid[who], asked.column("vec_id").to_numpy()[who], a_label[who], slot[own][t], r_uid[near[z]], r_vec[near[z]], s))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)

    return run


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, rows_a_cell: int = ROWS_A_CELL, anchors_a_cell: int = ANCHORS_A_CELL) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by ``every``) and each of its first ``positives`` rows of the same label the first ``negatives`` rows of
    other labels whose score is ``lowest`` to ``highest`` percent of the positive's. ``embeddings`` has vec_id, label and embedding."""
    spark = embeddings.sparkSession
    folder = shared_dir(spark)
    table = saved(quantised(embeddings).withColumn("uid", F.monotonically_increasing_id()), folder, "table")
    size = table.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"), F.max(F.size("q")).alias("dims")).first()
    dims = max(1, size.dims or 0)
    axes = principal_axes(table, dims)
    steps = sorted({max(1, dims // 4), max(1, dims // 2)})
    whole = F.struct(F.lit(0).cast("long").alias("slot"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    anchors = table.where(F.col("vec_id") % every == 0)

    def asked(of: DataFrame, k: int, same: bool) -> DataFrame:
        left, right = _cells(table, of, size.n, size.anchors, rows_a_cell, anchors_a_cell)
        found = left.cogroup(right).applyInArrow(_asker(axes, steps, k, same), _FOUND_DDL)
        rank = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "found_id", "found_uid")
        return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    good = saved(asked(anchors.withColumn("slots", F.array(whole)), positives, True), folder, "positives")
    # 100 * score within [lowest, highest] * positive score: least and greatest integer in range (div and % truncate)
    low, high = f"score * {lowest}", f"score * {highest}"
    exact = {"low": F.expr(f"{low} div 100 + if({low} % 100 > 0, 1, 0)"), "high": F.expr(f"{high} div 100 - if({high} % 100 < 0, 1, 0)")}
    wanted = good.withColumns(exact).where("low <= high").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("slot"), "low", "high"))).alias("slots"))
    bad = asked(anchors.join(wanted, "uid"), negatives, False)
    pair = good.select("uid", F.col("rank").cast("long").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    bad = bad.select("uid", "slot", "anchor_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return bad.join(pair, ["uid", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
