"""Vectorised words: split many texts at once, hash each word and each run of words, without a Python object per word.

A word's hash chains its bytes, eight at a time, through a mixer that is one-to-one in each step, so that no regular
structure of a text makes words collide (powers of one base modulo 2**64 would let strings of the Thue-Morse kind collide
for every base). Words of more than ``LONG`` bytes get 64 bits of a cryptographic digest. Runs of words are powers of one
base over such hashes. Two different words or short runs get one hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = bytes(range(9, 14)) + b" "
#: Byte maps for ``bytes.translate``: separators become a space.
SPACED = bytes(32 if b in _SPACES else b for b in range(256))
SPACED_LOWER = bytes(32 if b in _SPACES else _LOWER[b] for b in range(256))
#: Only digits, letters and bytes over 0x7F belong to words; letters A-Z in lower case.
ALNUM_LOWER = bytes(_LOWER[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Longest word, in bytes, that is hashed eight bytes at a time.
LONG = 256
#: Most powers that a worker remembers; longer tables are made anew and dropped.
_KEPT_POWERS = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _powers_of(step: np.uint64, n: int) -> np.ndarray:
    full = np.full(n, step, np.uint64)
    full[:1] = 1
    return np.multiply.accumulate(full)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _KEPT_POWERS:
        return _powers_of(_STEP, n), _powers_of(_BACK, n)
    if len(_powers.get("up", ())) < n:
        size = 1 << max(0, n - 1).bit_length()
        _powers["up"], _powers["down"] = _powers_of(_STEP, size), _powers_of(_BACK, size)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The low 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Words:
    """Words of several texts: ``data[start:end]`` are their bytes; text i has the words ``bounds[i]:bounds[i + 1]``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def plain(self) -> list[bytes]:
        """All words, in order."""
        return [self.data[s:e] for s, e in zip(self.start.tolist(), self.end.tolist())]


def split(values: list[bytes], alphabet: bytes, hashed: bool = True) -> Words:
    data = b" ".join(values).translate(alphabet)
    buf = np.frombuffer(data, np.uint8)
    gap = np.empty(len(buf) + 2, np.int8)
    gap[0] = gap[-1] = 1
    np.equal(buf, 32, out=gap[1:-1].view(bool))
    step = np.diff(gap)
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) + 1 for v in values], out=offsets[1:])
    bounds = np.searchsorted(start, offsets)
    return Words(data, start, end, bounds, _hash(data, buf, start, end) if hashed else np.empty(0, np.uint64))


def _hash(data: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    out = size.astype(np.uint64) * _STEP
    eights = np.lib.stride_tricks.as_strided(np.concatenate([buf, np.zeros(8, np.uint8)]), (len(buf) + 1, 8), (1, 1))
    left, at = np.arange(len(start)), 0
    while len(left):
        part = eights[start[left] + at].view(np.uint64)[:, 0] & _LOW[np.minimum(size[left] - at, 8)]
        out[left] = mix((out[left] ^ part) + _STEP)
        at += 8
        left = left[(size[left] > at) & (size[left] <= LONG)]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Runs:
    """Hashes of runs of consecutive words, for any length, from one prefix sum."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _power(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = (np.asarray(end) - np.asarray(start)).astype(np.uint64)
        return mix((self.total[end] - self.total[start]) * self.down[start] + n)


def run_starts(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``length`` words that lie in one text, and each run's text."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[text] + bounds[:-1][text], text
