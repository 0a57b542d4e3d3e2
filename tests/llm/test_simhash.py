import random
import re

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ravelin.llm import _words, simhash
from ravelin.llm._graph import components

WORD = rb"[^\x20\x09-\x0D]+"


def plain_fingerprint(text, k=3):
    w = re.findall(WORD, re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, distance=3):
    """component_id of each (doc_id, fingerprint) with an id, by all pairs."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if bin(x ^ prints[j][1]).count("1") <= distance:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(prints))]


def rows_of(texts, df, **how):
    keyed = [(d, plain_fingerprint(t)) for d, t in texts]
    own = [x for x in keyed if x[0] is not None]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(own, plain_groups(own))] + [(None, f"{f:016x}", None) for d, f in keyed if d is None]
    got = [tuple(r) for r in simhash.groups(df, **how).collect()]
    return sorted(got, key=repr), sorted(want, key=repr)


TEXTS = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "a b"), (6, "A  B\t"), (7, "ä ß É b"), (7, "ä ß É b"), (None, "a b c d"), (9, "a b c d"), (9, "other words than those before"), (10, "x" * 5000 + " y z")]


def test_fingerprints_and_groups_as_brute_force(spark):
    r = random.Random(7)
    texts = list(TEXTS)
    for _ in range(14):
        base = [r.choice("abcdefghij") + str(r.randint(0, 99)) for _ in range(r.randint(40, 300))]
        for _ in range(r.randint(1, 8)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            texts.append((len(texts) + r.randint(0, 3) * 1000, " ".join(w)))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, fp int, mask string").repartition(4)
    got, want = rows_of(texts, df)
    assert got == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want}), "some links are needed"
    kept = simhash.drop_duplicates(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {None, *(c for _, _, c in want if c is not None)}
    assert simhash.groups(df.limit(0)).count() == 0


def test_xxhash_is_that_of_spark(spark):
    df = spark.createDataFrame([("a b c",), ("ä  ß",), ("",)], "t string")
    assert [r.h % 2**64 for r in df.select(F.xxhash64("t").alias("h")).collect()] == [xxh64_intdigest(t.encode(), 42) for t in ("a b c", "ä  ß", "")]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice("abCé \n") for _ in range(4000)) + "w" * 90 + " z"
    whole = simhash.fingerprint(text.encode())
    for piece in (1, 2, 7, 50):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert simhash.fingerprint(text.encode()) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [4096, 60])
def test_links_in_dense_buckets(spark, tmp_path, bucket):
    """Fingerprints drawn closely around few centres: large buckets are cut again and again, and nothing is lost."""
    r = random.Random(bucket)
    prints = {r.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for centre in (0, 1 << 63, r.getrandbits(64)):
        for _ in range(120):
            x = centre
            for b in r.sample(range(64), r.choice([1, 2, 5, 8])):
                x ^= 1 << b
            prints.add(x)
    prints = [(i, x) for i, x in enumerate(sorted(prints))]
    signed = [(x - 2**64 if x >> 63 else x,) for _, x in prints]
    classes = spark.createDataFrame(signed, "fp long").withColumn("pivots", simhash.pivot_distances(F.col("fp")))
    found = components(simhash.links(classes, f"file://{tmp_path}", 3, bucket), f"file://{tmp_path}", "c")
    label = {r.node % 2**64: r.component for r in found.collect()}
    want = plain_groups(prints)
    groups = {}
    for (_, x), c in zip(prints, want):
        groups.setdefault(c, set()).add(label.get(x, ("alone", x)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_pivots_never_discard_a_link():
    piv = _words.keys(simhash.PIVOTS, simhash.PIVOT_SEED).tolist()
    r = random.Random(3)
    for _ in range(500):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), 3):
            y ^= 1 << b
        assert all(abs(bin(x ^ p).count("1") - bin(y ^ p).count("1")) <= 3 for p in piv)
    for d in (1, 3):
        masks = simhash.finer(0, d)
        assert len(masks) == d + 1 and sum(masks) == (1 << 64) - 1
