"""Hashes of words and of 5-word shingles, worked out on whole texts with array operations."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

WIDTH = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a text hashed at a time; a longer word is hashed whole.
_PART = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables():
    letters = np.arange(256, dtype=np.uint64)
    letters[ord("A") : ord("Z") + 1] += np.uint64(32)  # A-Z count as a-z
    return mix(letters + np.uint64(0x1234567))


_VALUE = _tables()
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _words_of_part(data: np.ndarray) -> np.ndarray:
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _BASE)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of a text given as UTF-8 bytes, A-Z read as a-z."""
    if len(data) <= _PART:
        return _words_of_part(data)
    cuts, at = [0], _PART
    while at < len(data):
        blank = np.flatnonzero(_SPACE[data[at : at + _PART]])
        if len(blank):
            cuts.append(at + int(blank[0]))
            at = cuts[-1] + _PART
        else:
            at += _PART
    return np.concatenate([_words_of_part(data[a:b]) for a, b in zip(cuts, [*cuts[1:], len(data)])])


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the runs of ``width`` words in order; of fewer words, the whole run as one; of none, none."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _BASE + words[i : n - k + 1 + i])
    return out


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of every text of an Arrow column, without copying them; none for null."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [data[0:0] if no else data[a:b] for no, a, b in zip(null, ends[:-1].tolist(), ends[1:].tolist())]


def shingle_set(data: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text as sorted signed 64-bit numbers."""
    return np.unique(shingle_hashes(word_hashes(data), width).view(np.int64))


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
