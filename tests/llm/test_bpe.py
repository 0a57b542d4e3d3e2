import hashlib
import itertools
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import bpe, token_files

B = bpe.tokenizer(bpe.default_vocabulary())
PIECES = ["a", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "中", "!", "...", "1", "<|endoftext|>", "<|end", "\U0001f600", "don't", "\x85", " ", "\0", "the", " The", "_", "'T"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=40).map("".join)))
def test_same_ids_and_text_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    want = B.whole.encode(text, add_special_tokens=False).ids
    assert next(B.forms([text.encode()])) == (len(want), ",".join(map(str, want)).encode(), text.encode())
    assert next(B.encode([text.encode()])).tolist() == want
    assert B.decode(np.array(want)) == B.whole.decode(want, skip_special_tokens=False)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long")


def test_round_trip_nulls_and_clashing_columns(spark):
    rows = [(1, "Hello there", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (3, "", "x", 1), (None, "é" * 3000, "x", 1)]
    got = bpe.encode_digests(docs(spark, rows), bpe.default_vocabulary()).collect()
    assert len(got) == 5 and sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    back = {r.doc_id: r.text for r in bpe.decode_ids(bpe.encode_ids(docs(spark, rows), bpe.default_vocabulary()), bpe.default_vocabulary()).collect()}
    assert back == {1: "Hello there", 2: "", 3: "", None: "é" * 3000}
    assert bpe.encode_digests(docs(spark, []), bpe.default_vocabulary()).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 200])
def test_token_files(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(token_files, "PART_IDS", 100)
    rows = [(k, f"text number {k} " * (k % 7), "", 0) for k in range(150)] + [(7, None, "", 0), (None, "no id", "", 0)]
    folder = f"file://{tmp_path}/t"
    meta = token_files.tokens_to_files(docs(spark, rows).repartition(5), folder, bpe.default_vocabulary(), parts)
    assert token_files.read_meta(folder) == meta
    got = sorted(map(tuple, token_files.read(spark, folder, meta).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))):
        ids = np.array([*B.whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want and meta["ids"] == start
    assert [token_files.read_document(folder, meta, k)[0] for k in (0, 1, 4)] == [None, 0, 3]
    assert all(p["ids"] < 100 + 50 for p in meta["parts"]) and len(meta["parts"]) > 10


def test_one_id_or_none_fills_several_parts(spark, tmp_path):
    rows = [(5 if k % 3 else None, f"t {k}", "", 0) for k in range(300)] + [(9, "z", "", 0), (1, "a", "", 0)]
    folder = f"file://{tmp_path}/t"
    meta = token_files.tokens_to_files(docs(spark, rows), folder, bpe.default_vocabulary(), 8)
    got = sorted(map(tuple, token_files.read(spark, folder, meta).collect()), key=lambda r: r[1])
    ids = [r[0] for r in got]
    assert ids == [None] * 100 + [1] + [5] * 200 + [9] and max(p["docs"] for p in meta["parts"]) < 100
    assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]


def test_every_text_of_a_table_as_the_library(spark):
    """Digests of whole texts, and texts longer than a step, against the library."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()] + [(-1, "long é text, " * 40_000), (-2, "x" * 300_000)]
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_digests(spark.createDataFrame(rows, "doc_id long, text string"), bpe.default_vocabulary()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in rows:
        ids = B.whole.encode(t or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), sha(",".join(map(str, ids))), sha(B.whole.decode(ids, skip_special_tokens=False)))


def test_bytes_that_are_no_utf8():
    bad = b"ok \xff\xfe words \xc3 end"
    n, numbers, back = next(B.forms([bad]))
    assert n == numbers.count(b",") + 1 and back.decode("utf-8", "replace").startswith("ok ")


def test_a_file_with_another_pattern_has_no_cuts(tmp_path):
    spec = json.load(open(bpe.default_vocabulary()))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "v.json").write_text(json.dumps(spec))
    other = bpe.ForcedBoundaryBPE(str(tmp_path / "v.json"))
    assert not other.cut.any() and other.fragments([b"A B, C"])[1].tolist() == [0]
    assert next(other.encode([b"Hello, World"])).tolist() == other.whole.encode("Hello, World", add_special_tokens=False).ids
    spec["decoder"] = {"type": "Metaspace"}
    (tmp_path / "w.json").write_text(json.dumps(spec))
    with pytest.raises(Exception):
        bpe.ForcedBoundaryBPE(str(tmp_path / "w.json"))


def test_forgotten_fragments_are_learnt_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_FRAGMENTS", 3)
    own = bpe.ForcedBoundaryBPE(bpe.default_vocabulary())
    for k in range(20):
        text = f"word{k} and word{k % 3}, again" * (k + 1)
        assert next(own.encode([text.encode()])).tolist() == B.whole.encode(text, add_special_tokens=False).ids


def test_no_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    meta = token_files.tokens_to_files(docs(spark, []), folder, bpe.default_vocabulary(), 4)
    assert meta["parts"] == [] and token_files.read(spark, folder, meta).count() == 0
