"""Whole batches of texts as NumPy arrays: word bounds and 64-bit hashes of words and word runs.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D),
which in UTF-8 are the matches of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_R, _Q = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h.copy()
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def text_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the offsets of the texts (one more than texts). Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each text (one more than texts)."""
    n = len(buf)
    word = np.zeros(n + 2, dtype=bool)
    np.logical_not(SPACE[buf], out=word[1:-1])
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words only, and the distinct words by number."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.int64), []
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    letters = np.ascontiguousarray(buf[~SPACE[buf]])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False).tolist()


def hashed(words: list[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(seed)), dtype=_U, count=len(words))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    codes, words = word_codes(buf, starts, ends)
    return hashed(words, seed)[codes] if len(codes) else np.zeros(0, dtype=_U)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two hashed runs one after the other. Every step is mixed, so no relation between runs carries over."""
    return mix(mix(a + _R) * _Q + b)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of h[i:i+k] for each i that has so many, joining runs of doubling length."""
    if len(h) < k:
        return np.zeros(0, dtype=_U)
    out, have, power, bits, size = None, 0, h, k, 1
    while bits:
        if bits & 1:
            out = power if out is None else joined(out[: len(power) - have], power[have:])
            have += size
        bits >>= 1
        if bits:
            power = joined(power[:-size], power[size:])
            size *= 2
    return mix(out[: len(h) - k + 1])


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The polynomial rolling hash of h[i:i+k] for each i: the sum of h[i+j] times the (k-1-j)th power of an odd number,
    modulo 2^64, then mixed."""
    total = np.zeros(max(0, len(h) - k + 1), dtype=_U)
    for j in range(k):
        total = total * _Q + h[j : j + len(total)]
    return mix(total)
