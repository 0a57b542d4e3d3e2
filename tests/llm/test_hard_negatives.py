import math
import random

import numpy as np
import pytest

from ravelin.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, q int, uid string"


def plain(rows, every=5, positives=5, negatives=3):
    kept = [(v, lab, [math.floor(256 * float(np.float32(x))) for x in e]) for v, e, lab in rows if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (v, lab, q) in enumerate(kept):
        if v % every:
            continue
        others = sorted(((-dot(q, w), x, m) for k, (x, m, w) in enumerate(kept) if k != i), key=lambda t: t[:2])
        for s, p, m in [t for t in others if t[2] == lab][:positives]:
            good = [(n, t) for t, n, m in others if m != lab and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(v, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(good)]
    return out


def some(seed, n, dims, labels):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        c = r.choice(centres)
        v = [x * 0.3 + r.gauss(0, 0.5) for x in c]
        rows.append((i, v, centres.index(c) if r.random() < 0.7 else r.randrange(labels)))
    # ties, repeated rows, hot label, and what takes no part
    rows += [(n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), rows[3], rows[5], rows[5]]
    rows += [(n + 5, [0.0] * dims, 0), (n + 10, [0.0] * dims, 1), (n + 15, None, 1), (n + 20, [float("nan")] * dims, 1), (n + 25, [float("inf"), *[1.0] * (dims - 1)], 1), (n + 30, [None, *[1.0] * (dims - 1)], 1), (n + 35, [1.0] * dims, None), (None, [1.0] * dims, 1)]
    return rows


@pytest.mark.parametrize("seed,n,dims,labels,cell", [(1, 300, 16, 4, 64), (2, 200, 3, 2, 1000), (3, 120, 1, 1, 50), (4, 400, 8, 30, 90)])
def test_mining_as_brute_force(spark, seed, n, dims, labels, cell):
    rows = some(seed, n, dims, labels)
    df = spark.createDataFrame([(*x, 1, "u") for x in rows], SCHEMA).repartition(3)
    got = hard_negatives.mine(df, every=5, rows_a_cell=cell, anchors_a_cell=20)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_bounds_discard_pairs_and_keep_results():
    """Blocks smaller than the table, so floors of earlier blocks discard pairs of later ones."""
    r = np.random.default_rng(2)
    scale = np.array([900.0] * 4 + [60.0] * 28)
    q = np.floor(r.normal(size=(3000, 32)) * scale).astype(np.int64)
    axes = np.linalg.eigh((q.T @ q).astype(float))[1][:, ::-1].copy()
    x = hard_negatives.Rotated(q, axes, [8, 16])
    a = hard_negatives._slice(x, np.arange(20))
    seen = []
    plain_survivors = hard_negatives.survivors

    def counted(*args):
        out = plain_survivors(*args)
        seen.append((len(args[0]) * len(args[1]), len(out[0])))
        return out

    hard_negatives.survivors = counted
    try:
        none = np.full(20, -(1 << 62))
        step, hard_negatives.PAIRS = hard_negatives.PAIRS, 20 * 100
        t, j, s = hard_negatives._search(a, np.arange(20), x, np.arange(3000), lambda at: np.ones((20, len(at)), bool), none, -none, 5, [8, 16])
    finally:
        hard_negatives.survivors, hard_negatives.PAIRS = plain_survivors, step
    want = q[:20] @ q.T
    for k in range(20):
        order = np.lexsort((np.arange(3000), -want[k]))[:5]
        assert sorted(j[t == k]) == sorted(order) and sorted(s[t == k]) == sorted(want[k][order])
    pairs, left = map(sum, zip(*seen))
    assert pairs == 60_000 and left < 0.1 * pairs


def test_huge_components_and_empty(spark):
    df = spark.createDataFrame([(5, [1e30, 1.0], 1, 1, "u"), (10, [2.0], 1, 1, "u"), (15, [1.0, 1.0], 1, 1, "u"), (20, [0.9, 0.5], 2, 1, "u"), (25, [], 2, 1, "u")], SCHEMA)
    assert sorted(map(tuple, hard_negatives.mine(df, every=5).collect())) == [(10, 15, 1, 20, 131072, 117760), (15, 10, 1, 20, 131072, 91648), (25, 20, 1, 10, 0, 0), (25, 20, 2, 15, 0, 0)]
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_pairs_that_all_survive_take_bounded_memory():
    import tracemalloc

    q = np.ones((512, 64), np.int64)
    a = hard_negatives.Rotated(q, np.eye(64), [16, 32])
    everything = lambda u, i, j: np.ones(u.shape, bool)
    x = hard_negatives._slice(a, np.arange(hard_negatives.PAIRS // 512))
    tracemalloc.start()
    i, _, s = hard_negatives.survivors(a, x, [16, 32], everything, everything)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == hard_negatives.PAIRS and (s == 64).all() and peak < 64 << 20
