"""Operators that SQL can't express, against plain versions over a whole table."""

import hashlib
import math
from collections import Counter
from functools import cache

import pytest

from ravelin.operators import evaluation
from ravelin.operators.chunking import SEPARATORS
from ravelin.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def atoms(text, size, length, level=0):
    """The coarsest pieces that fit."""
    if length(text) <= size:
        return [text]
    while level < len(SEPARATORS) and not (SEPARATORS[level] and SEPARATORS[level] in text):
        level += 1
    if level >= len(SEPARATORS) - 1 and (level >= len(SEPARATORS) or not SEPARATORS[level]):
        return [text[i : i + size] for i in range(0, len(text), size)]
    out, sep = [], SEPARATORS[level]
    while text:
        at = text.find(sep)
        head, text = (text, "") if at < 0 else (text[: at + len(sep)], text[at + len(sep) :])
        out += atoms(head, size, length, level + 1)
    return out


def chunks(text, size, overlap, length):
    """Each chunk takes all the pieces that fit; the next begins at the earliest piece within the overlap from which the next new piece fits."""
    p = atoms(text, size, length)
    n = [length(x) for x in p]
    out, first, end = [], 0, 0
    while end < len(p):
        while first < end and (sum(n[first:end]) > overlap or sum(n[first : end + 1]) > size):
            first += 1
        end += 1
        while end < len(p) and sum(n[first : end + 1]) <= size:
            end += 1
        out.append("".join(p[first:end]).strip())
    return [x for x in out if x]


@pytest.mark.parametrize("name, size, overlap, length", [("recursive_chunks", 512, 128, len), ("token_sized_chunks", 800, 100, lambda s: len(s.split()))])
def test_splitters(spark, texts, name, size, overlap, length):
    got = {}
    for r in registry.queries()[name](spark, SF).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in texts.items():
        want = chunks(t, size, overlap, length) if t else []
        rows = got.get(d, [])
        assert [r.chunk_no for r in rows] == list(range(len(want)))
        assert [r.text for r in rows] == want and [r.n_chars for r in rows] == [len(x) for x in want]


def test_hyde(spark, texts):
    def vector(t):
        v = [0] * 64
        for w in t.lower().split():
            h = int(hashlib.blake2b(w.encode(), digest_size=8).hexdigest(), 16)
            v[h % 64] += 1 if h >= 1 << 63 else -1
        size = math.sqrt(sum(x * x for x in v)) or 1
        return [x / size for x in v]

    asked = [vector(t) for t in ("the license of this", "of and to the", "an answer in the text", "that is the question")]
    mean = [sum(x) / 4 for x in zip(*asked)]
    size = math.sqrt(sum(x * x for x in mean))
    score = {d: sum(a * b for a, b in zip(vector(t), mean)) / size for d, t in texts.items() if t and t.split()}
    got = {r.doc_id: r.score for r in registry.queries()["hyde_offline"](spark, SF).collect()}
    assert all(abs(score[d] - s) < 2e-6 for d, s in got.items())
    assert len(got) == 10 and min(score[d] for d in got) >= max(s for d, s in score.items() if d not in got) - 2e-6


def longest(a, b):
    @cache
    def of(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + of(i + 1, j + 1) if a[i] == b[j] else max(of(i + 1, j), of(i, j + 1))

    return of(0, 0)


def bleu(c, r):
    if not c or not r or not set(c) & set(r):
        return 0.0
    shares = []
    for k in (1, 2, 3, 4):
        have, want = (Counter(" ".join(x[i : i + k]) for i in range(len(x) - k + 1)) for x in (c, r))
        good = sum(min(v, want[g]) for g, v in have.items())
        shares.append((good + (k > 1)) / (sum(have.values()) + (k > 1)))
    return math.prod(shares) ** 0.25 * (1 if len(c) >= len(r) else math.exp(1 - len(r) / len(c)))


def test_rouge_and_bleu(spark):
    pairs = [("1", "a b c d e f", "a c b d f"), ("2", "", "x"), ("3", None, None), ("4", "x y", "z"), ("5", "the cat sat on the mat", "the cat on the mat sat there now"), ("6", "q q q", "q"), ("6", "Same Text here now", "same text HERE now")]
    df = spark.createDataFrame(pairs, "id string, candidate string, reference string")
    for got, (i, c, r) in zip(evaluation.text_scores(df.coalesce(1)).collect(), pairs):
        a, b = (c or "").lower().split(), (r or "").lower().split()
        n = longest(tuple(a), tuple(b))
        assert got.id == i and abs(got.rouge_l - (2 * n / (len(a) + len(b)) if n else 0)) < 1e-6 and abs(got.bleu - bleu(a, b)) < 1e-6
