import collections
import hashlib
import random
import re

import pytest

from ravelin.llm import near_duplicates, substring_dedup
from ravelin.llm._graph import components

GAP = r"[^\x20\x09-\x0D]+"


def groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(GAP, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_as_brute_force(spark, k, percent):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One"), (5, "one two")]
    for g in range(12):
        base = [r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(r.randint(8, 120))]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows) + r.randint(0, 3) * 1000, " ".join(w)))
    rows = list({d: (d, t) for d, t in rows}.values())
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_shingles int").repartition(4)
    assert sorted(map(tuple, near_duplicates.groups(df, k, percent).collect())) == groups(rows, k, percent)
    kept = near_duplicates.drop_duplicates(df, k, percent)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == [x[0] for x in groups(rows, k, percent) if x[3]]


@pytest.mark.parametrize("weight", [100, 200, 2_000_000])
def test_contested_clusters_are_compared_in_blocks(spark, monkeypatch, weight):
    monkeypatch.setattr(near_duplicates, "SHINGLES_A_BLOCK", weight)
    monkeypatch.setattr(near_duplicates, "ROWS_A_BLOCK", 4)
    r = random.Random(1)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(60):
        w = list(base)
        for p in r.sample(range(40), 2):
            w[p] = f"y{r.randint(0, 3)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates.groups(df, 3, 85).collect())) == groups(rows, 3, 85)


def test_empty_and_shared_ids(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (None, "a b c"), (8, "A B C\n")], "doc_id long, text string")
    got = collections.Counter(map(tuple, near_duplicates.groups(df, 3, 85).collect()))
    assert got == {(5, 1, 5, True): 2, (None, 1, None, True): 1, (8, 1, 5, False): 1}
    assert near_duplicates.groups(df.limit(0), 3, 85).count() == 0


def test_rows_that_share_an_id_are_kept_or_dropped_one_by_one(spark):
    rows = [(1, "a b c d e f", 0), (2, "a b c d e f", 1), (2, "a text of its own", 2), (None, "a b c d e f", 3), (None, "only here and nowhere else", 4), (None, "only here and nowhere else", 5), (7, None, 6), (7, None, 7), (8, "q r s t u v", 8), (8, "q r s t u v", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = near_duplicates.drop_duplicates(df, 3, 85)
    assert got.columns == df.columns
    kept = sorted((tuple(x)[:2] for x in got.collect()), key=repr)
    assert kept == sorted([(1, "a b c d e f"), (2, "a text of its own"), (None, "only here and nowhere else"), (7, None), (7, None), (8, "q r s t u v")], key=repr)


def test_bands_keep_links():
    for percent in (70, 80, 85, 95):
        n, rows = near_duplicates.bands(percent)
        assert (1 - (percent / 100) ** rows) ** n <= near_duplicates.MISS
    least = near_duplicates.least_agreements(85, 160)
    assert [n for n, _ in least] == [32, 64, 96, 128, 160] and all(m < 0.85 * n for n, m in least)


def test_components(spark, tmp_path):
    r = random.Random(2)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(280, 320)] + [(k, 400) for k in range(380, 400)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), f"file://{tmp_path}", "c").collect()))
    assert got == {x: root(x) for a, b in links for x in (a, b) if a != b} | {x: root(x) for x in got}


def removed(rows, n):
    words = [re.findall(GAP, t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n,limit,sampled", [(1, 500_000, 0.5), (2, 500_000, 1.0), (5, 500_000, 0.02), (5, 500_000, 0.5), (13, 500_000, 1.0), (5, 0, 0.5)])
def test_substrings_as_brute_force(spark, monkeypatch, n, limit, sampled):
    monkeypatch.setattr(substring_dedup, "BROADCAST_TEXTS", limit)
    monkeypatch.setattr(substring_dedup, "SAMPLED", sampled)
    monkeypatch.setattr(substring_dedup, "SALTS", 3)
    r = random.Random(3)
    base = [r.choice("abc") for _ in range(300)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(r.randint(0, 5)):
            a = r.randint(0, 280)
            w += base[a : a + r.randint(1, 20)] + ["z"] * (r.randint(1, 40) if r.random() < 0.2 else 0) + [str(r.randint(0, 3))]
        rows.append((i // 2 if i % 7 else None, r.choice([" ", "\n", "\t "]).join(w) if i % 11 else None))
    rows += rows[:5]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_words int")
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, substring_dedup.remove_repeats(df, n).collect()), key=key) == sorted(removed(rows, n), key=key)
    assert n > 1 or substring_dedup.remove_repeats(df.limit(0), n).count() == 0


@pytest.mark.parametrize("chunk", [5, 40])
def test_components_over_many_chunks(spark, tmp_path, chunk):
    """Chains, stars and a clique, with chunks that hold a small part of the links."""
    r = random.Random(chunk)
    links = [(k, k + 1) for k in range(0, 120)] + [(500 + k, 501 + k) for k in r.sample(range(100), 95)] + [(900, k) for k in range(800, 950)] + [(r.randint(1000, 1040), r.randint(1000, 1040)) for _ in range(60)] + [(7, 7), (5, None)]
    r.shuffle(links)
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in links:
        if b is not None and a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(4), f"file://{tmp_path}", "c", chunk).collect()
    assert len(got) == len({x.node for x in got})
    assert dict(map(tuple, got)) == {x: root(x) for x in up}
