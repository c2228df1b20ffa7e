"""Vectorised word hashing for Arrow batches: numpy passes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer texts are handled alone and whole.
CHUNK = 1 << 21
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: words of letters, digits and non-ASCII characters only
ALNUM = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_pow = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, CHUNK + 65536)
        for name, base in (("p", _BASE), ("q", _INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[name] = np.multiply.accumulate(a)
        _pow["n"] = size
    p, q = _pow["p"], _pow["q"]
    if n > CHUNK + 65536:  # do not keep the tables of one very long text
        _pow["n"] = 0
    return p, q


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """Words of some texts: hashes, byte spans in `data`, and per text the range `at[i]:at[i+1]` of its words."""

    def __init__(self, texts: list[bytes], lower: bool = True, is_word: np.ndarray = _IS_WORD):
        self.data = b"".join(t + b" " for t in texts)
        raw = np.frombuffer(self.data, np.uint8)
        if lower:
            raw = _LOW[raw]
        self.bytes = raw
        n = len(raw)
        w = np.zeros(n + 2, bool)
        w[1:-1] = is_word[raw]
        step = np.flatnonzero(w[1:] != w[:-1])
        self.start, self.end = step[::2], step[1::2]
        p, q = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * p[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * q[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.at = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def batches(texts: list[bytes], lower: bool = True, is_word: np.ndarray = _IS_WORD) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its words) by chunk."""
    for a, b in chunks(texts):
        yield a, Words(texts[a:b], lower, is_word)


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that Words gives to single words."""
    return np.concatenate([Words([w.encode()], False).hash[:1] for w in words]) if words else np.zeros(0, np.uint64)
