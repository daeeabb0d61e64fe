"""Words of Arrow text columns as 64-bit hashes in numpy arrays, and a hash table over such keys.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. Two words share a hash with
a chance of about 2^-64 a pair; counts and sets are exact but for that.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93  # base of the polynomial hash, odd
_PIECE = 1 << 20  # bytes hashed at once; bounds the 8-byte arrays below


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit keys."""
    x = x + U(salt * _ODD & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    return mix(left * U(_STEP) + right, 7)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = mix(np.arange(1, 257, dtype=U))
_POWERS = np.cumprod(np.full(_PIECE + 1, _STEP, dtype=U))
_INVERSE = np.cumprod(np.full(_PIECE + 1, pow(_STEP, -1, 2**64), dtype=U))
END = U(0x5EED5EED5EED5EED)  # stands for the end of a text


class Words(NamedTuple):
    """hashes of all words; words of text i are those from offsets[i] to offsets[i + 1]."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column (null: empty) and where each text begins, with the end at last."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        part = data[base : ends[j - 1]]
        if len(part) > _PIECE:  # one very long word
            total = U(0)
            for at in range(0, len(part), _PIECE):
                some = part[at : at + _PIECE]
                total = mix(np.array([total], dtype=U))[0] ^ (_LETTER[some] * _POWERS[: len(some)]).sum(dtype=U)
            out[i] = total
        else:
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum(_LETTER[part] * _POWERS[: len(part)], out=sums[1:])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * _INVERSE[a]
        i = j
    return mix(out + (ends - starts).astype(U) * U(_ODD))


def words(texts: pa.Array) -> Words:
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        return Words(np.zeros(0, U), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    data = _LOWER[data]
    space = _SPACE[data]
    begins, stops = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    begins[1:] = space[: n]
    begins[offsets] = True
    stops[:n] = space
    stops[offsets] = True
    starts = np.flatnonzero(~space & begins[:n])
    ends = np.flatnonzero(~space & stops[1:]) + 1
    return Words(_hashed(data, starts, ends), np.searchsorted(starts, offsets), starts, ends)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Table:
    """Values for distinct 64-bit keys; a lookup is a few gathers, whatever the size."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.mask, self.shift = U((1 << bits) - 1), U(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        self.keys, self.values = keys.astype(U), values
        left = np.arange(len(keys), dtype=np.int32)
        at = self._first(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + U(1)) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        """Keys may be hashes or pairs of small numbers."""
        return keys * U(_ODD) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is missing."""
        out = np.full(len(keys), -1, dtype=np.int32)
        todo, at = np.arange(len(keys)), self._first(keys)
        while len(todo):
            got = self.slots[at]
            hit = got >= 0
            same = np.zeros(len(got), dtype=bool)
            same[hit] = self.keys[got[hit]] == keys[todo[hit]]
            out[todo[same]] = got[same]
            on = hit & ~same
            todo, at = todo[on], (at[on] + U(1)) & self.mask
        return out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U)
