import random

import pyarrow as pa

from ravelin.llm import _store, _words


def test_hashes_dont_depend_on_the_block(monkeypatch):
    r = random.Random(4)
    texts = [b" ".join(bytes(r.choices(b"abcXYZ", k=r.randint(1, 9))) for _ in range(n)) for n in (0, 3, 500, 900)] + [b"x" * 3000, b"\n"]
    words = _words.split(texts)
    whole = _words.hashes(words)
    rolled = {k: _words.rolling(whole, k, 3).tolist() for k in (1, 5, 300, 5000)}
    monkeypatch.setattr(_words, "BLOCK", 100)
    assert _words.hashes(words).tolist() == whole.tolist() and len(whole) == 1404
    assert all(_words.rolling(whole, k, 3).tolist() == v for k, v in rolled.items())
    assert len(_words.hashes(_words.split([]))) == 0 and len(_words.hashes(_words.split([b"", b" "]))) == 0


def test_text_steps_cover_every_row_once(monkeypatch):
    monkeypatch.setattr(_store, "STEP_BYTES", 10)
    rows = [b"abc", None, b"", b"x" * 50, b"abcdefgh", b"ab", None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["text"])
    steps = list(_store.text_steps(batch))
    assert [t for _, _, part in steps for t in part] == [t or b"" for t in rows]
    assert all(j - i == len(part) for i, j, part in steps) and [i for i, _, _ in steps[1:]] == [j for _, j, _ in steps[:-1]]
    assert list(_store.text_steps(batch.slice(0, 0))) == []
