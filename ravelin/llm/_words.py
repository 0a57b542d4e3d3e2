"""Word boundaries and word hashes of many documents at once, over UTF-8 bytes.

A word is a run of bytes other than space, tab, \\n, \\v, \\f and \\r, which is the same
as a run of such code points because those bytes never occur inside a longer UTF-8 sequence.

Hashes are chains and trees of a mixing step, not sums, so no arrangement of few symbols (as in
sequences that cancel in polynomials modulo 2**64) makes unequal words or windows meet.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_U64 = np.uint64
_MASK = (1 << 64) - 1
#: Values that one step of a rolling hash runs over, so that a long text needs no longer arrays.
BLOCK = 1 << 18
#: Bytes of a range that are hashed eight at a time; a longer one is digested by itself.
LONG = 512
#: Bytes a buffer has after its last range, so that eight can be read from anywhere in it.
SPARE = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal only for equal inputs."""
    x = x + _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(n, dtype=_U64) + _U64((seed * 0x632BE59BD9B4E019) & _MASK))


SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: What to keep of eight bytes read little-endian when n of them are asked for.
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], _U64)


@dataclass
class Words:
    """The words of some documents: byte ranges in ``data``, and words [first[d], first[d + 1]) of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(texts: list[bytes], lower: bool = False) -> Words:
    """Words of each text; ``lower`` lower-cases A-Z and nothing else."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" * (1 + SPARE), np.uint8)
    if lower:
        data = LOWER[data]
    gap = SPACE[data]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]  # the data ends with a space, so each start has its end
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, bounds))


def chunks(data: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 8 of each range as a number, with zeros after its end."""
    eight = np.ndarray(len(data) - SPARE + 1, "<u8", data, strides=(1,))
    return eight[start + 8 * k] & KEEP[np.minimum(size - 8 * k, 8)]


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each range; ``data`` has SPARE bytes after the last."""
    size = end - start
    out = mix(size.astype(_U64))
    on, k = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(on):
        out[on] = mix(out[on] ^ chunks(data, start[on], size[on], k))
        k += 1
        on = on[size[on] > 8 * k]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    return range_hashes(words.data, words.start, words.end)


def rolling(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of values[i:i + k] for every i up to len - k, joined from hashes of runs of 1, 2, 4, ... values."""
    count = len(values) - k + 1
    if count < 1:
        return np.zeros(0, _U64)
    salt = keys(3, seed) | _U64(1)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * salt[0]
        x ^= x >> _U64(32)
        x += b
        x *= salt[1]
        x ^= x >> _U64(29)
        return x

    out = np.empty(count, _U64)
    step = max(BLOCK, k)
    for i in range(0, count, step):
        run = values[i : min(i + step, count) + k - 1]
        n = len(run) - k + 1
        whole, done, width = None, 0, 1
        while True:
            if k & width:
                part = run[done : done + n]
                whole, done = part if whole is None else join(whole, part), done + width
            if 2 * width > k:
                break
            run = join(run[:-width], run[width:])
            width *= 2
        out[i : i + step] = mix(whole ^ salt[2])
    return out
