"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so the text
may be cut between those two bytes. Fragments between cuts are encoded independently, each
distinct one once for a worker, and their ids are concatenated. What is known of a fragment is
found for all fragments of a step at once, by hash and then byte for byte.

A cut is taken only where the tokenizer's splitting into words can't see across it either:
the byte before it is printable ASCII or ends a character of U+00C0 to U+00FF (so no white
space, whose splitting looks ahead), the byte after it starts a character, and is no
apostrophe unless a letter or digit precedes (contractions are matched from the left).
Pairs inside added tokens count as occurring, so a special token in the text stays whole.
A file whose words are not those of the plain byte-level pattern (another pre-tokenizer, a
normalizer, stripping added tokens) has no cuts: whole texts are encoded.

Defined cases: a null text is an empty one and has no ids; decoding invalid UTF-8 gives
U+FFFD as the tokenizers library does; repeated rows and clashing column names are kept as
they are because only the columns named here are read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import _words as W
from ravelin.llm._store import text_steps

#: Distinct fragments a worker remembers (and 64 bytes for each of them in all), and the longest of them in bytes; beyond that they are encoded again.
CACHE_FRAGMENTS, CACHE_BYTES = 800_000, 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ragged(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at[0]:at[0] + n[0]], then the next such range, and so on."""
    ends = np.cumsum(n)
    return flat[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Table:
    """Byte strings by number, side by side."""

    def __init__(self, rows: list[bytes]):
        self.n = np.array([len(r) for r in rows], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.flat = np.frombuffer(b"".join(rows), np.uint8)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``ids`` side by side, and the end of each."""
        n = self.n[ids]
        return ragged(self.flat, self.at[ids], n), np.cumsum(n)


class Known:
    """Fragments met before and their ids: a table by hash whose slots are overwritten, checked byte for byte.

    When the fragments held pass CACHE_FRAGMENTS all are forgotten, so a worker's memory is bounded.
    """

    SLOTS = 1 << 21

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.slot_key, self.slot_row = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        # row 0 stands for no fragment
        self.count, self.n_bytes, self.n_ids = 1, 0, 0
        self.rows = np.zeros((4, 1024), np.int32)
        self.bytes, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, self.kind)

    def find(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The row of each fragment, 0 where it isn't held."""
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        row = np.where(self.slot_key[slot] == h, self.slot_row[slot], 0)
        on = np.flatnonzero(row)
        same = self.rows[1, row[on]] == size[on]
        row[on[~same]] = 0
        on, k = on[same], 0
        while len(on):
            same = W.chunks(data, start[on], size[on], k) == W.chunks(self.bytes, self.rows[0, row[on]], size[on], k)
            row[on[~same]] = 0
            k += 1
            on = on[same & (size[on] > 8 * k)]
        return row

    def add(self, fragments: list[bytes], ids: np.ndarray, counts: np.ndarray, h: np.ndarray) -> int:
        """Hold new fragments with their ids side by side; returns the row of the first, the others follow."""
        n = np.array([[len(f) for f in fragments], counts], np.int64)
        first, end = self.count, self.count + len(fragments)
        n_bytes, n_ids = self.n_bytes + int(n[0].sum()), self.n_ids + int(n[1].sum())
        for name, want in (("bytes", n_bytes + W.SPARE), ("ids", n_ids)):
            held = getattr(self, name)
            if len(held) < want:
                setattr(self, name, np.concatenate([held, np.zeros(max(want - len(held), len(held)), held.dtype)]))
        if self.rows.shape[1] < end:
            self.rows = np.concatenate([self.rows, np.zeros((4, max(end, self.rows.shape[1])), np.int32)], axis=1)
        self.bytes[self.n_bytes : n_bytes] = np.frombuffer(b"".join(fragments), np.uint8)
        self.ids[self.n_ids : n_ids] = ids
        ends = np.cumsum(n, axis=1) - n
        self.rows[:, first:end] = self.n_bytes + ends[0], n[0], self.n_ids + ends[1], n[1]
        self.count, self.n_bytes, self.n_ids = end, n_bytes, n_ids
        short = np.flatnonzero(n[0] <= CACHE_BYTES)
        slot = (h[short] & np.uint64(self.SLOTS - 1)).astype(np.int64)
        self.slot_key[slot], self.slot_row[slot] = h[short], first + short
        return first


class ForcedBoundaryBPE:
    """Encoder and decoder over one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str, plain: bool = False):
        """``plain`` reads the strings of special tokens in a text as ordinary text."""
        from tokenizers import Tokenizer

        self.path = path
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("only byte-level vocabularies are decoded")
        to_byte = byte_of_char()
        size = 1 + max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), 0)
        self.bytes_of = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.cut = self._cuts() if _provable(spec) else np.zeros(1 << 16, bool)
        self.kind = "H" if size <= 1 << 16 else "I"
        self.text_table, self.number_table = Table(self.bytes_of), Table([b"%d," % i for i in range(size)])
        self.known = Known(self.kind)

    def _cuts(self) -> np.ndarray:
        """cut[256 * a + b]: a text may always be cut between bytes a and b (for a over 0x7F, see fragments)."""
        inside = np.zeros((256, 256), bool)
        for token in self.bytes_of:
            x = np.frombuffer(token, np.uint8)
            inside[x[:-1], x[1:]] = True
        cut = ~inside
        cut[:0x21] = cut[0x7F] = cut[0xC0:] = False
        cut[:, 0x80:0xC0] = False
        alnum = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]
        cut[[a for a in range(256) if a not in alnum], ord("'")] = False
        return cut.reshape(-1)

    def fragments(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end, first): the texts' fragments as ranges of one buffer; those of text k are first[k] to first[k + 1]."""
        joined = b"\0".join(texts) + b"\0" * (1 + W.SPARE)
        data = np.frombuffer(joined, np.uint8)
        ok = self.cut[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]
        high = data[:-1] >= 0x80
        latin = np.zeros(len(high), bool)
        latin[1:] = data[:-2] == 0xC3
        at = np.flatnonzero(ok & (~high | latin)) + 1
        n = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(n + 1) - (n + 1)
        # no cut follows the zero byte between two texts; one before it is the end of a text
        stops = np.zeros(len(data) + 1, bool)
        stops[begin + n] = True
        at = at[~stops[at]]
        at = at[at < begin[-1] + n[-1]] if len(n) else at[:0]
        begin, stop = begin[n > 0], (begin + n)[n > 0]
        first = np.searchsorted(starts := np.sort(np.concatenate([begin, at])), np.cumsum([0, *(n + 1)]))
        return joined, starts, np.sort(np.concatenate([at, stop])), first

    def _learnt(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments side by side, and how many each has.

        They are encoded in rows that the library takes as one text: fragments follow each other
        where a cut is forced between them, and the bytes of the ids tell where each ends.
        """
        ends = np.cumsum([len(f) for f in fragments])
        data = np.frombuffer(b"\0" + b"".join(fragments), np.uint8)
        last, after = data[ends[:-1]], data[ends[:-1] + 1]
        joins = self.cut[last.astype(np.uint16) * np.uint16(256) + after] & ((last < 0x80) | (data[ends[:-1] - 1] == 0xC3))
        edges = [0, *(np.flatnonzero(~joins) + 1).tolist(), len(fragments)]
        texts = [b"".join(fragments[i:j]) for i, j in zip(edges[:-1], edges[1:])]
        try:
            encoded = self.whole.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.kind) for e in encoded])
            reached = np.cumsum(self.text_table.n[ids])
            upto = np.searchsorted(reached, ends)
            if np.array_equal(reached[upto], ends):
                return ids, np.diff(upto + 1, prepend=0)
        except (UnicodeDecodeError, IndexError):
            pass  # bytes that are no UTF-8, or that the vocabulary has no token for: one by one
        encoded = [np.array(e.ids, self.kind) for e in self.whole.encode_batch_fast([f.decode("utf-8", "replace") for f in fragments], add_special_tokens=False)]
        return np.concatenate(encoded), np.array([len(e) for e in encoded])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): the ids of all texts; those of text k are ids[edges[k]:edges[k + 1]]."""
        known = self.known
        if known.count > CACHE_FRAGMENTS or known.n_bytes > 64 * CACHE_FRAGMENTS:
            known.clear()
        joined, start, end, first = self.fragments(texts)
        data, size = np.frombuffer(joined, np.uint8), end - start
        h = W.range_hashes(data, start, end)
        row = known.find(data, start, size, h)
        missing = np.flatnonzero(row == 0)
        if len(missing):
            wanted = [joined[i:j] for i, j in zip(start[missing].tolist(), end[missing].tolist())]
            place: dict[bytes, int] = {}
            order = [place.setdefault(f, len(place)) for f in wanted]
            new = list(place)
            order = np.array(order, np.int64)
            at = np.zeros(len(new), np.int64)
            at[order] = missing
            row[missing] = known.add(new, *self._learnt(new), h[at]) + order
        n = known.rows[3, row]
        edges = np.concatenate([[0], np.cumsum(n)])[first]
        return ragged(known.ids, known.rows[2, row], n), edges

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text in the vocabulary's unsigned type."""
        ids, edges = self.ids(texts)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield ids[i:j]

    def forms(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text the number of its ids, the ids in decimal joined by commas, and the bytes they decode to."""
        ids, edges = self.ids(texts)
        held = []
        for table in (self.number_table, self.text_table):
            flat, ends = table.of(ids)
            held.append((flat.tobytes(), np.concatenate([[0], ends])[edges].tolist()))
        (numbers, number_at), (back, back_at) = held
        for k, n in enumerate(np.diff(edges).tolist()):
            yield n, numbers[number_at[k] : max(number_at[k], number_at[k + 1] - 1)], back[back_at[k] : back_at[k + 1]]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included."""
        return self.text_table.of(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


def _provable(spec: dict) -> bool:
    """Whether the forced cuts hold for the file: its words must be those of the plain byte-level pattern. Otherwise whole texts are encoded."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    added = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in spec["added_tokens"])
    affixes = model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout")
    return bool(plain and added and not spec.get("normalizer") and not affixes)


@cache
def tokenizer(path: str, plain: bool = False) -> ForcedBoundaryBPE:
    """One of each kind per worker process.

    Spark already runs a worker for each core, so the library must not start threads of its own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ForcedBoundaryBPE(path, plain)


def _text_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i, j, texts in text_steps(batch):
                n, ids, back = [], [], []
                for count, numbers, raw in bpe.forms(texts):
                    n.append(count)
                    ids.append(hashlib.sha256(numbers).hexdigest())
                    back.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_ids(docs: DataFrame, path: str, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns ``keep``, text_sha256, n_tokens and n_plain (with the strings of special tokens read as ordinary text) of whole texts."""
    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).cast("string").cast("binary").alias("text"))
    held = [f for f in cols.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual, plain = tokenizer(path), tokenizer(path, True)
        special = [t.content.encode() for t in usual.whole.get_added_tokens_decoder().values()]
        for batch in batches:
            for i, j, texts in text_steps(batch):
                n = np.diff(usual.ids(texts)[1])
                other = n.copy()
                # the two differ only in texts that hold such a string
                odd = [k for k, t in enumerate(texts) if any(s in t for s in special)]
                other[odd] = np.diff(plain.ids([texts[k] for k in odd])[1]) if odd else 0
                own = [batch.column(c).slice(i, j - i) for c in range(len(held))]
                sha = pa.array([hashlib.sha256(t).hexdigest() for t in texts])
                yield pa.RecordBatch.from_arrays([*own, sha, pa.array(n, pa.int64()), pa.array(other, pa.int64())], names=[*(f.name for f in held), "text_sha256", "n_tokens", "n_plain"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held)
    return cols.mapInArrow(run, f"{schema}, text_sha256 string, n_tokens long, n_plain long")


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """doc_id, n_tokens and the ids as packed little-endian integers of the vocabulary's width (2 or 4 bytes).

    ``end_id`` is appended to every document if given.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        kind = id_type(len(bpe.bytes_of))
        width = np.dtype(kind).itemsize
        for batch in batches:
            for i, j, texts in text_steps(batch):
                tail = np.array([] if end_id is None else [end_id], kind).tobytes()
                ids = [x.astype(kind, copy=False).tobytes() + tail for x in bpe.encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    return _text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of what encode_ids gives (without an end id): doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        kind = id_type(len(bpe.bytes_of))
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", kind)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def id_type(vocabulary: int) -> str:
    """Narrowest unsigned integer that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"
