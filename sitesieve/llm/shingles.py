"""Word shingles of whole texts, hashed a batch at a time with numpy.

Words are runs of bytes other than ASCII white space, A-Z lower-cased.  Each
byte is replaced by a fixed random 64-bit value; a word's hash is its
polynomial hash (from prefix sums), finished with a mixer, so one batch takes a
few passes over its bytes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  #: bytes of text worked on at a time (a longer text makes a chunk of its own)
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += _U(32)
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    return mix(lower + _U(0x51ED270B)), space


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows) for runs of whole texts; a null text is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Shingler:
    """Distinct ``k``-word shingles of each text, as sorted 64-bit hashes.

    A text of fewer than ``k`` words has its whole word sequence as its one
    shingle; a text without words has none.
    """

    def __init__(self, k: int):
        self.k = k
        self.byte, self.space = _tables()
        self.power = self.inverse = np.ones(1, dtype=np.uint64)
        self.weight = mix(np.arange(1, k + 1, dtype=np.uint64) * _U(_BASE)) | _U(1)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, CHUNK)
            for name, base in (("power", _BASE), ("inverse", _INVERSE)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, first word of each text and the end)."""
        n = len(data)
        if n == 0:
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n)
        inside = ~self.space[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        ends = np.flatnonzero(inside & (~after | edge[1:]))
        total = np.cumsum(self.byte[data] * self.power[:n])
        left = np.where(starts > 0, total[starts - 1], _U(0))
        h = mix((total[ends] - left) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        return h, np.searchsorted(starts, offsets)

    def sets(self, texts: pa.Array) -> Iterator[np.ndarray]:
        k = self.k
        for _, data, offsets in chunks(texts):
            h, first = self.words(data, offsets)
            if len(h) >= k:
                runs = sum(h[i : len(h) - k + 1 + i] * self.weight[i] for i in range(k))
                runs = mix(runs)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                if b - a >= k:
                    yield np.unique(runs[a : b - k + 1])
                elif b > a:
                    yield mix((h[a:b] * self.weight[: b - a]).sum(keepdims=True) + _U(b - a))
                else:
                    yield np.empty(0, np.uint64)
