import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ravelin.llm import prefix_trie
from ravelin.llm._ranks import running

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def tied(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, tied(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(family, [])[:h] + t[h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def words(key):
        return len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0

    def below(key):
        todo, out = [key], []
        while todo:
            out.append(todo.pop())
            todo += children.get(out[-1], [])
        return out

    out = []
    for key, convs in nodes.items():
        sub = below(key)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(key))
        out.append(
            (min(convs), len(key), min(nodes[key[:-1]]) if key else None, len(convs), len(children.get(key, [])), sum(x not in children for x in sub), sum((len(nodes[x]) - 1) * words(x) for x in sub), hashlib.sha256(ends.encode()).hexdigest())
        )
    return out


def some_rows(seed, convs, texts="abc"):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 130), convs):
        for t in range(r.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, t, None, 0]), r.choice(["user", "bot", None]), r.choice([None, "", *texts, "two  words", "Ünï\n" * 40])))
    return rows + rows[:4] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed,convs", [(1, 90), (2, 30), (3, 2)])
def test_trie_as_brute_force(spark, seed, convs):
    rows = some_rows(seed, convs)
    df = spark.createDataFrame([(*x, 5, "n") for x in rows], SCHEMA).repartition(5)
    got = prefix_trie.trie(df).collect()
    assert sorted((tuple(x)[:8] for x in got), key=repr) == sorted(plain_trie(rows), key=repr)
    # places are a preorder: a subtree is what lies between a node's place and its end
    assert sorted(x.preorder for x in got) == list(range(len(got)))
    at = {x.preorder: x for x in got}
    for x in got:
        inside = [at[p] for p in range(x.preorder + 1, x.subtree_end)]
        assert all(y.depth > x.depth for y in inside) and (x.subtree_end == len(got) or at[x.subtree_end].depth <= x.depth)


def test_one_conversation_holds_most_turns_and_most_are_copies(spark):
    rows = [(20, t, "user", f"t {t % 7}") for t in range(200)] + [(c, 0, "user", "same start") for c in range(41, 60)] + [(c, 1, "bot", f"{c % 3}") for c in range(41, 60)]
    df = spark.createDataFrame([(*x, 5, "n") for x in rows], SCHEMA)
    assert sorted((tuple(x)[:8] for x in prefix_trie.trie(df).collect()), key=repr) == sorted(plain_trie(rows), key=repr)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(df).count() == 0
    # 27: h = crc32("27") % 4 turns come from a family that isn't there, and it has no more of its own
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    only = spark.createDataFrame([(c, 0, "user", "x", 1, "n")], SCHEMA)
    assert [tuple(x)[:8] for x in prefix_trie.trie(only).collect()] == plain_trie([(c, 0, "user", "x")]) and plain_trie([(c, 0, "user", "x")])[0][1] == 0


def test_running_sums_over_ranges(spark, tmp_path):
    df = spark.range(1000).select(F.expr("id * 7919 % 1000 AS k"), (F.col("id") % 5).alias("v")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["k"], f"file://{tmp_path}", "x", ("v",)).orderBy("k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for i, x in enumerate(got):
        assert (x.pos, x.before_v) == (i, total)
        total += x.v
